"""Repair of one conversation the plain way: the least (cost, audit) over all prefixes, as lists of whole edits."""

import hashlib

BLANKS = " \t\n\x0b\x0c\r"


def plain_report(rows, keep=0, rerole=1, delete=2, insert=5, truncated=5):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of (turn, role, text) rows in their order."""
    seen, faults = set(), []
    for _, role, text in rows:
        rest = text.rstrip(BLANKS)
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def relax(best):
        for _ in range(4):
            for state in list(best):
                for role in ("user", "assistant"):
                    if (state, role[0]) in follows:
                        cost, audit, lines = best[state]
                        way = (cost + insert, audit + "I", [*lines, f"{role}:"])
                        to = follows[state, role[0]]
                        best[to] = min(best.get(to, way), way, key=lambda w: w[:2])
        return best

    best = relax({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, (cost + delete, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = truncated if fault else 0
                for sign, price, given in (("K", keep, role), ("R", rerole, "user"), ("R", rerole, "assistant")):
                    if (state, given[:1]) in follows:
                        ways.append((follows[state, given[:1]], (cost + price + extra, audit + sign, [*lines, f"{given}:{text}"])))
            for to, way in ways:
                new[to] = min(new.get(to, way), way, key=lambda w: w[:2])
        best = relax(new)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda fault: faults.count(fault)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
