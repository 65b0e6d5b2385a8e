"""The seven cleaning steps, in their fixed order, each also usable alone.

exact duplicates, column names, missing report, outlier report, whitespace,
spelling variants, numbers in text. Outliers look at columns that are numeric
already, before text is turned into numbers; variants look at text whose
whitespace is already cleaned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import cleaned_number, col_of, js_number, missing_of, number_text, squeeze_spaces, strip_spaces
from . import wording as w
from .dedup import drop_exact_duplicates
from .order_statistics import lower_quartile, order_statistics, upper_quartile

# Fence width, least count of numbers for fences, step names of the report.
FENCE = 1.5
LEAST_VALUES = 4
STEPS = (
    "Remove duplicates", "Fix column names", "Handle missing values", "Detect outliers",
    "Normalize text", "Clean categoricals", "Clean numbers",
)



def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# --- column names -------------------------------------------------------------

CONTROL_SIGNS = dict.fromkeys([*range(32), 127])


def clean_name(name: str) -> str:
    """Words of a name parted by single blanks, without control characters; a name with nothing else stays."""
    return " ".join(name.strip().translate(CONTROL_SIGNS).split()) or name


def suffix_repeats(names: list[str]) -> list[str]:
    """Names told apart: a repeat carries the number of its equals before it, as in a, a_1, a_2."""
    before = [names[:i].count(name) for i, name in enumerate(names)]
    return [f"{name}_{n}" if n else name for name, n in zip(names, before)]


def fix_column_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Renamed frame and the old-to-new mapping. Names that collide get a suffix; no column is lost."""
    new = suffix_repeats([clean_name(c) for c in df.columns])
    return df.toDF(*new), dict(zip(df.columns, new))


# --- missing values -----------------------------------------------------------

def missing_report(df: DataFrame) -> DataFrame:
    """One row per column with its count of null or empty cells, from one scan."""
    counted = df.agg(*[F.count_if(missing_of(df, c)).alias(c) for c in df.columns])
    return counted.unpivot([], [col_of(c) for c in df.columns], "column", "missing")


# --- outliers -----------------------------------------------------------------

@dataclass(frozen=True)
class Fences:
    n: int
    q1: float
    q3: float

    @property
    def lower(self) -> float:
        return self.q1 - FENCE * (self.q3 - self.q1)

    @property
    def upper(self) -> float:
        return self.q3 + FENCE * (self.q3 - self.q1)

    def outside(self, c: Column) -> Column:
        v = c.cast("double")
        return F.coalesce((v < self.lower) | (v > self.upper), F.lit(False))


def iqr_fences(df: DataFrame, columns: list[str] | None = None) -> dict[str, Fences]:
    """Exact quartile fences of every numeric column with enough values."""
    columns = numeric_columns(df) if columns is None else columns
    stats = order_statistics(df, {c: col_of(c) for c in columns}, {"q1": lower_quartile, "q3": upper_quartile})
    return {c: Fences(s["n"], float(s["q1"]), float(s["q3"])) for c, s in stats.items() if s["n"] >= LEAST_VALUES}


def outlier_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: quartiles, fences and the count of values outside."""
    fences = iqr_fences(df, columns)
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, n bigint, q1 double, q3 double, lower double, upper double, outliers bigint")
    counted = df.agg(*[F.count_if(f.outside(col_of(c))).alias(c) for c, f in fences.items()])
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(f.n).cast("bigint").alias("n"), F.lit(f.q1).alias("q1"), F.lit(f.q3).alias("q3"),
            F.lit(f.lower).alias("lower"), F.lit(f.upper).alias("upper"), col_of(c).alias("outliers"),
        )
        for c, f in fences.items()
    ]
    return counted.select(F.inline(F.array(*rows)))


def flag_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All rows, with one `<column>_outlier` flag per numeric column. Nothing is removed."""
    fences = iqr_fences(df, columns)
    return df.withColumns({f"{c}_outlier": f.outside(col_of(c)) for c, f in fences.items()})


# --- whitespace ---------------------------------------------------------------

def normalize_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = text_columns(df) if columns is None else columns
    return df.withColumns({c: squeeze_spaces(col_of(c)) for c in columns})


def normalize_text_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per text column: how many cells the whitespace step changes."""
    columns = text_columns(df) if columns is None else columns
    counted = df.agg(*[F.count_if(squeeze_spaces(col_of(c)) != col_of(c)).alias(c) for c in columns])
    return counted.unpivot([], [col_of(c) for c in columns], "column", "changed_cells")


# --- spelling variants --------------------------------------------------------

def variant_key(c: Column) -> Column:
    return F.lower(strip_spaces(c))


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def case_variants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, key, canonical): every text that occurs in more than one spelling.

    Least and greatest spelling differ exactly when there are two or more, so
    the aggregate keeps two strings per key, combines on the map side, and needs
    no list of spellings however often a key occurs.
    """
    columns = text_columns(df) if columns is None else columns
    cells = df.unpivot([], [col_of(c) for c in columns], "column", "value").where("value IS NOT NULL")
    per_key = cells.groupBy("column", variant_key(F.col("value")).alias("key")).agg(
        F.min("value").alias("first"), F.max("value").alias("last")
    )
    # An empty key is kept out: there is nothing to write differently.
    several = per_key.where((F.col("first") != F.col("last")) & (F.col("key") != ""))
    return several.select("column", "key", sentence_case(F.col("key")).alias("canonical"))


def merge_case_variants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Give all spellings of a text the same form.

    Each column meets its own variants in a left join. How is Spark's choice: by broadcast where the variants' size in bytes
    allows it, else by a shuffle whose large partitions are split, so a text that fills a third of the table is no
    single task's work.
    """
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return df
    variants = case_variants(df, columns)
    out = df
    for c in columns:
        mapping = variants.where(F.col("column") == c).select(F.col("key").alias("_key"), F.col("canonical").alias("_canonical"))
        out = out.withColumn("_key", variant_key(col_of(c))).join(mapping, "_key", "left")
        out = out.withColumn(c, F.coalesce(F.col("_canonical"), col_of(c))).drop("_key", "_canonical")
    return out.select(*[col_of(c) for c in df.columns])


# --- numbers in text ----------------------------------------------------------

def clean_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Percent and currency cells become plain number text; other cells stay as they are."""
    columns = text_columns(df) if columns is None else columns
    return df.withColumns({c: F.coalesce(number_text(cleaned_number(col_of(c))), col_of(c)) for c in columns})


def promote_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn text columns into doubles where every filled cell is a number."""
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return df
    counts = df.agg(
        *[F.count_if(~missing_of(df, c)).alias(f"f{i}") for i, c in enumerate(columns)],
        *[F.count_if(js_number(col_of(c)).isNotNull()).alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    full = [c for i, c in enumerate(columns) if counts[f"f{i}"] and counts[f"f{i}"] == counts[f"n{i}"]]
    return df.withColumns({c: js_number(col_of(c)) for c in full})


# --- all steps ----------------------------------------------------------------

@dataclass
class Cleaned:
    df: DataFrame
    report: DataFrame
    original_rows: int
    cleaned_rows: int
    original_columns: int
    renamed: dict[str, str]
    missing_cells: int = 0
    outliers: int = 0
    _held: DataFrame | None = None

    def release(self) -> None:
        """Drop the deduplicated table from the executors; `df` is then computed from its source."""
        if self._held is not None:
            self._held.unpersist()

    @property
    def duplicates_removed(self) -> int:
        return self.original_rows - self.cleaned_rows


REPORT_SCHEMA = "step string, description string, affected_rows bigint, affected_columns array<string>"


def clean_dataset(df: DataFrame) -> Cleaned:
    """Run every step and report what each changed.

    The deduplicated table is persisted because the outlier, variant and final
    passes all read it; the report itself comes out of one aggregate.
    """
    original_rows = df.count()
    renamed_df, mapping = fix_column_names(drop_exact_duplicates(df))
    base = renamed_df.persist()
    texts, numbers = text_columns(base), numeric_columns(base)
    fences = iqr_fences(base, numbers)

    # Marks of what each step changes travel with the row, so one aggregate counts all of them.
    marked = base.withColumns(
        {
            **{f"_m{i}": missing_of(base, c) for i, c in enumerate(base.columns)},
            **{f"_o{i}": f.outside(col_of(c)) for i, (c, f) in enumerate(fences.items())},
            **{f"_t{i}": squeeze_spaces(col_of(c)) != col_of(c) for i, c in enumerate(texts)},
            **{f"_s{i}": squeeze_spaces(col_of(c)) for i, c in enumerate(texts)},
        }
    )
    merged = merge_case_variants(normalize_text(marked, texts), texts)
    out = clean_numbers(merged.select(*[col_of(c) for c in base.columns]), texts)

    report_row = merged.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"_m{i}")).alias(f"m{i}") for i in range(len(base.columns))],
        *[F.count_if(F.col(f"_o{i}")).alias(f"o{i}") for i in range(len(fences))],
        *[F.count_if(F.col(f"_t{i}")).alias(f"t{i}") for i in range(len(texts))],
        *[F.count_if(col_of(c) != F.col(f"_s{i}")).alias(f"v{i}") for i, c in enumerate(texts)],
        *[F.count_if(cleaned_number(col_of(c)).isNotNull()).alias(f"p{i}") for i, c in enumerate(texts)],
    ).first()
    cleaned_rows = report_row["rows"]
    renamed = [new for old, new in mapping.items() if old != new]

    def hit(prefix: str, names: list[str]) -> list[str]:
        return [c for i, c in enumerate(names) if report_row[f"{prefix}{i}"]]

    def amount(prefix: str, names: list[str]) -> int:
        return sum(report_row[f"{prefix}{i}"] for i in range(len(names)))

    names = base.columns
    removed, missing, outliers = original_rows - cleaned_rows, amount("m", names), amount("o", list(fences))
    missing_in, outliers_in = hit("m", names), hit("o", list(fences))
    counted = ", ".join(f"{c}({report_row[f'm{names.index(c)}']})" for c in missing_in)
    found = w.STEP_MISSING.format(n=missing, k=len(missing_in), columns=counted) if missing_in else w.STEP_NO_MISSING
    flagged = w.STEP_OUTLIERS.format(n=outliers, k=len(outliers_in)) if outliers else w.STEP_NO_OUTLIERS
    rows = [
        (STEPS[0], w.STEP_DUPLICATES.format(n=removed), removed, list(df.columns)),
        (STEPS[1], w.STEP_NAMES.format(n=len(renamed)), cleaned_rows if renamed else 0, renamed),
        (STEPS[2], found, 0, missing_in),
        (STEPS[3], flagged, 0, outliers_in),
        (STEPS[4], w.STEP_TEXT.format(n=amount("t", texts)), amount("t", texts), hit("t", texts)),
        (STEPS[5], w.STEP_VARIANTS.format(n=amount("v", texts)), amount("v", texts), hit("v", texts)),
        (STEPS[6], w.STEP_NUMBERS.format(n=amount("p", texts)), amount("p", texts), hit("p", texts)),
    ]
    report = df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
    return Cleaned(out, report, original_rows, cleaned_rows, len(df.columns), mapping, missing, outliers, base)
