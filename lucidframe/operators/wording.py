"""The sentences of insights, KPIs and summaries."""

from __future__ import annotations

# Output texts. Numbers are filled in already formatted.
LEADER = (
    '"{top}" dominates {what} — accounting for {value} ({share}% of total {total}), '
    "averaging {average} per record across {records} entries."
)
LEADER_EVIDENCE = 'Aggregated "{measure}" grouped by "{category}" across {rows} records.'
BOTTOM = '"{low}" has the lowest {what} at {value} ({records} records){less}.'
BOTTOM_LESS = " — {times}x less than the top performer"
CONCENTRATION = (
    "High concentration: {names} together hold {share}% of total {what} ({value} of {total}). "
    "Remaining {others} groups share the other {rest}%."
)
CONCENTRATION_EVIDENCE = "Top 3 of {n} {groups} groups by sum."
SKEW = (
    "Distribution is heavily skewed — the median {groups} contributes {median} vs. a mean of {mean}, "
    "indicating a few large players pull the average up significantly."
)
SKEW_EVIDENCE = "Median vs mean comparison across {n} groups."
GROWTH = "Overall, {what} {moved} by {percent}% from {first} ({first_value}) to {last} ({last_value}) over {n} periods."
GROWTH_EVIDENCE = "First vs last period comparison across {n} distinct {time} values."
MOMENTUM = "Most recent period ({last}): {value} — a {percent} change from the prior period ({previous}: {previous_value})."
PEAK = "Peak {what} occurred in {peak} at {value} — {now}."
PEAK_BELOW = "current level is {percent}% below peak"
PEAK_HELD = "currently at or above peak"
EXTREME = (
    "{label} shows extreme range — max value ({high}) is {times}x the average ({mean}). "
    "Median is {median}, suggesting right-skewed distribution."
)
EXTREME_EVIDENCE = "Descriptive stats from {rows} values: min={low}, max={high}, mean={mean}, median={median}."
WIDE_GROWTH = "{latest} vs {previous}: {percent} change ({previous_value} → {latest_value})."
WIDE_GROWTH_EVIDENCE = "Sum of {rows} records across both periods."
WIDE_PEAK_LOW = "Peak period is {peak} with {peak_value}. Lowest is {low} at {low_value}."
WIDE_PEAK_LOW_EVIDENCE = "Compared aggregates across {n} periods."
CAGR = "Compound annual growth rate (CAGR) across {steps} periods: {percent}."
CAGR_EVIDENCE = "Calculated from first period ({first_value}) to last ({latest_value}) over {steps} periods."
WIDE_LEADER = '"{top}" leads in {latest} with {value} ({share}% share).'
WIDE_LEADER_EVIDENCE = "Ranked {n} {groups} groups by {latest} values."
WIDE_BOTTOM = '"{low}" has the lowest {latest} value at {value}.'
WIDE_CONCENTRATION = "Top 3 {groups} account for {share}% of {latest} total — high concentration."
WIDE_CONCENTRATION_EVIDENCE = "Top 3 sum {value} out of total {total}."
WIDE_SPAN = "Dataset spans {n} periods from {first} to {latest} across {rows} records."

KPI_RECORDS = "Total Records"
KPI_TOTAL = "Total {label}"
KPI_AVERAGE = "Avg {label}"
KPI_GROUPS = "{label} Groups"
KPI_HIGHEST = "Highest {label}"
KPI_LATEST = "Latest Period ({latest})"
KPI_GRAND_TOTAL = "Grand Total"
KPI_PERIOD_AVERAGE = "Period Average"
KPI_GROWTH = "Growth ({previous} → {latest})"
KPI_DISTINCT = "Distinct {label}"

GREW, DECLINED = "grew", "declined"
SCOPE = "This analysis covers {rows} records{spanning}."
SCOPE_SPANNING = " spanning {parts}"
SCOPE_GROUPS = "{n} {groups} groups"
SCOPE_PERIODS = "{n} {time} periods ({first}–{last})"
MAIN = (
    "The total {what} across all records is {total}, with individual values ranging from {low} to {high} "
    "(average: {mean}, median: {median})."
)
MAIN_SKEWED = (
    "The average is significantly higher than the median, indicating a right-skewed distribution where a small number of "
    "high-value entries pull the overall figures upward."
)
MAIN_LEADER = 'Among {n} {groups} groups, "{top}" leads with {value} in total {what} ({share}% market share).'
MAIN_CHANGE = "From {first} to {last}, total {what} {moved} by {percent}% ({first_value} → {last_value})."
WIDE_SCOPE = "This analysis covers {rows} records over {n} periods ({first} to {latest})."
WIDE_TOTALS = (
    "The aggregate total across all periods is {total}, averaging {average} per period. "
    "The latest period ({latest}) totals {value}{against}."
)
WIDE_AGAINST = " ({percent} vs. period average)"
WIDE_CHANGE = "From {first} to {latest}, values {moved} by {percent}% ({first_value} → {latest_value})."
WIDE_LAST_CHANGE = "The most recent period-over-period change is {percent}."
WIDE_SUMMARY_LEADER = 'Among {n} {groups} groups, "{top}" leads the latest period with {value} ({share}% share).'

CHART_OVER_TIME = "{measure} Over {time}"
CHART_BY = "{measure} by {category}"
CHART_SHARE = "{measure} Share by {category}"
CHART_RECORD_SHARE = "Record Distribution by {category}"
CHART_TREND = "{measure} Trend"
CHART_PAIR = "{x} vs {y}"
CHART_RECORDS = "Records by {category}"
CHART_DISTRIBUTION = "Distribution by {category}"
CHART_TOTAL_OVER_TIME = "Total Over Time"
CHART_VOLUME = "Volume Trend"
CHART_PERIOD_BY = "{period} by {category}"
CHART_PERIOD_SHARE = "{period} Share"
CHART_LEADERS = "Top {category} Over Time"

STEP_DUPLICATES = "Removed {n} exact duplicate row(s)"
STEP_NAMES = "Cleaned {n} column name(s): trimmed whitespace, replaced special characters, collapsed underscores"
STEP_MISSING = "Found {n} missing value(s) across {k} column(s): {columns}"
STEP_NO_MISSING = "No missing values detected"
STEP_OUTLIERS = "Flagged {n} outlier value(s) in {k} numeric column(s) using IQR method (not removed)"
STEP_NO_OUTLIERS = "No outliers detected in numeric columns"
STEP_TEXT = "Trimmed and collapsed whitespace in {n} cell(s)"
STEP_VARIANTS = "Merged spelling variants in {n} cell(s)"
STEP_NUMBERS = "Turned {n} percent or currency cell(s) into numbers"

TEXT_OVER_TIME = "Trend of {measure} across {n} {time} periods."
TEXT_BY = "How {measure} distributes across {category}."
TEXT_SHARE = "Proportional distribution of {measure} across {category}."
TEXT_RECORD_SHARE = "Share of records across top {category} categories."
TEXT_SECOND = "Comparison across {category}."
TEXT_TREND = "Cumulative view of {measure} over time."
TEXT_PAIR = (
    "Shows a {strength} {direction} relationship (r={r}) between these two measures. Each dot represents one record. "
    'Higher "{x}" values tend to {tend} "{y}" values.'
)
TEXT_TOGETHER, TEXT_OPPOSED = "coincide with", "be paired with lower"
TEXT_WIDER = "{measure} breakdown across {category} groups."
TEXT_RECORDS = "Number of records in each {category} category."
TEXT_DISTRIBUTION = "Proportional share of records."
TEXT_TOTALS = "Aggregate totals across {n} periods from {first} to {last}."
TEXT_VOLUME = "Cumulative volume pattern showing growth and seasonal variation across periods."
TEXT_PERIOD_BY = "Latest period values broken down by {category}."
TEXT_PERIOD_SECOND = "Breakdown by {category} for the latest period."
TEXT_PERIOD_SHARE = "Proportional share of {period} values by {category}."
TEXT_LEADERS = "Comparing the top {n} {category} groups across all periods."

CONTEXT_NOTE = "Note: columns {columns} may have abbreviated names from the source file."
CONTEXT_COLUMN = '"{name}" (numeric, range: {low} – {high})'
NO_DATA = "No data to analyze."
