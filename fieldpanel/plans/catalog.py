"""Every query with, where SQL can express it, an independent SQL statement for the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.functions import scalar
from fieldpanel.ml import evaluate, models, search, select, seqreg
from fieldpanel.ml import importance as ml_importance
from fieldpanel.operators import batching, clean, curves, history, importance, match, metrics, profile, reshape, split
from fieldpanel.plans import pipeline
from fieldpanel.plans.adapter import RAW_SQL, raw_wide, table
from fieldpanel.schemas import (
    AGES,
    BOUNDED_INDICES,
    DATE_COLS,
    INDEX_COLS,
    RATE_COLS,
    RAW_SCHEMA,
    RECORD_KEY,
    TASSELED_CAP,
    THRESHOLDS,
)
from fieldpanel.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


MEAN_DIGITS = 9  # means of many short decimals often end in a 5 at the seventh place


def query(name: str, sql: str | None = None, digits: int = DIGITS) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: scalar.round_columns(function(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


# --- SQL building blocks -------------------------------------------------------------------------------------


def rounded(columns: list[str], prefix: str = "", digits: int = DIGITS) -> str:
    # Adding 0 turns a negative zero into zero.
    return ", ".join(f"round({prefix}{c}, {digits}) + 0e0 AS {c}" for c in columns)


def listed(columns: list[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in columns)


HARD = r"CAST(regexp_extract(SpcsCmp, 'HW (\d+)', 1) AS int)"
SOFT = r"CAST(regexp_extract(SpcsCmp, 'SW (\d+)', 1) AS int)"
CLASS_SQL = (
    f"CASE WHEN {HARD} >= 0.8 * ({HARD} + {SOFT}) THEN 'Decidous' "
    f"WHEN {SOFT} >= 0.8 * ({HARD} + {SOFT}) THEN 'Conifer' ELSE 'Mixed' END"
)
RULES_SQL = [
    "(NmbrPlR IS NULL OR NmbrPlR = 0)",
    "(" + " AND ".join(f"{c} IS NOT NULL" for c in INDEX_COLS) + ")",
    "Year >= Season",
    "(" + " AND ".join(f"{c} BETWEEN -1 AND 1" for c in BOUNDED_INDICES) + ")",
]
CLEAN_SQL = f"""{RAW_SQL},
clean AS (SELECT ID, PixelID, Season, CASE WHEN NmbrPlR IS NULL THEN {CLASS_SQL} ELSE Type END AS Type,
  {listed(RATE_COLS + DATE_COLS)}, ImgDate, DOY, {listed(INDEX_COLS)}, Planted / Area_ha AS Density
  FROM raw WHERE {" AND ".join(RULES_SQL)})"""
SURVEY_SQL = f"""{CLEAN_SQL},
rates AS ({" UNION ".join(f"SELECT ID, PixelID, Density, Type, Season, {k} AS Age, SrvvR_{k} AS target FROM clean WHERE SrvvR_{k} IS NOT NULL" for k in AGES)}),
dates AS ({" UNION ".join(f"SELECT ID, PixelID, {k} AS Age, AsssD_{k} AS SrvvR_Date FROM clean WHERE AsssD_{k} IS NOT NULL" for k in AGES)}),
survey AS (SELECT rates.*, SrvvR_Date FROM rates JOIN dates USING (ID, PixelID, Age) WHERE target BETWEEN 0 AND 100)"""


def match_sql(days: int) -> str:
    return f"""{SURVEY_SQL},
means AS (SELECT s.ID, s.PixelID, s.Age, {", ".join(f"avg(o.{c}) AS {c}" for c in INDEX_COLS)}
  FROM survey s JOIN clean o ON s.ID = o.ID AND s.PixelID = o.PixelID
   AND o.ImgDate BETWEEN s.SrvvR_Date - {days} AND s.SrvvR_Date + {days} GROUP BY ALL),
matched AS (SELECT s.*, {listed(INDEX_COLS, "m.")} FROM survey s LEFT JOIN means m USING (ID, PixelID, Age))"""


MATCH_SQL = match_sql(16)
TABLES_SQL = f"""{SURVEY_SQL},
obs AS (SELECT DISTINCT ID, PixelID, ImgDate, DOY, {listed(INDEX_COLS)} FROM clean),
lookup AS (SELECT DISTINCT ID, PixelID, SrvvR_Date, Age, Density, Type, target FROM survey),
records AS (SELECT DISTINCT ID, PixelID, SrvvR_Date FROM lookup),
placed AS (SELECT *, row_number() OVER (PARTITION BY ID, PixelID ORDER BY ImgDate, DOY, {listed(INDEX_COLS)}) AS pos FROM obs),
steps AS (SELECT r.ID, r.PixelID, r.SrvvR_Date, p.pos, ln(1 + date_diff('day', p.ImgDate, r.SrvvR_Date)) AS log_dt,
  -cos(2 * pi() * p.DOY / 365) AS neg_cos_DOY, {listed(INDEX_COLS, "p.")}
  FROM records r JOIN placed p ON r.ID = p.ID AND r.PixelID = p.PixelID AND p.ImgDate <= r.SrvvR_Date),
lengths AS (SELECT ID, PixelID, SrvvR_Date, count(*) AS seq_len FROM steps GROUP BY ALL),
stats AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in TASSELED_CAP)},
  (SELECT avg(Density) FROM lookup) AS m_Density, (SELECT stddev_samp(Density) FROM lookup) AS s_Density FROM obs)"""
SPLIT_SQL = f"""{CLEAN_SQL},
ids AS (SELECT ID, row_number() OVER (ORDER BY md5(concat(ID, ':591'))) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT ID FROM clean))"""
SCORED_SQL = """WITH scored AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y_true, l.toxic,
  1 / (1 + d.n_chars / 1000e0) AS y_prob, CASE WHEN 1 / (1 + d.n_chars / 1000e0) < 0.5 THEN 1 ELSE 0 END AS y_pred
  FROM documents d JOIN labels l USING (doc_id)),
cells AS (SELECT sum(CAST(y_true = 0 AND y_pred = 0 AS bigint)) AS tp, sum(CAST(y_true = 0 AND y_pred = 1 AS bigint)) AS fn,
  sum(CAST(y_true = 1 AND y_pred = 0 AS bigint)) AS fp, sum(CAST(y_true = 1 AND y_pred = 1 AS bigint)) AS tn FROM scored)"""
CURVE_SQL = f"""{SCORED_SQL},
counts AS (SELECT y_prob AS score, count(*) FILTER (y_true = 0) AS pos, count(*) FILTER (y_true = 1) AS neg FROM scored GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg,
  lead(pos) OVER o AS next_pos, lead(neg) OVER o AS next_neg, row_number() OVER o AS i FROM counts
  WINDOW o AS (ORDER BY score DESC), d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def metric_columns(cells: str = "") -> str:
    tp, fn, fp, tn = (f"{cells}{c}" for c in ("tp", "fn", "fp", "tn"))
    rows = f"({tp} + {fn} + {fp} + {tn})"

    def rate(part: str, whole: str) -> str:
        return f"round(coalesce(({part}) * 1e0 / nullif({whole}, 0), 0), 6)"

    return (
        f"{rate(f'2 * {tp}', f'2 * {tp} + {fn} + {fp}')} AS f1, {rate(f'5 * {tp}', f'5 * {tp} + 4 * {fn} + {fp}')} AS f2, "
        f"{rate(tp, f'{tp} + {fp}')} AS precision, {rate(tp, f'{tp} + {fn}')} AS recall, "
        f"{rate(f'{tp} + {tn}', rows)} AS accuracy, round({rate(f'{tp} + {fn}', rows)} * 100, 6) AS pct_low, "
        f"round({rate(f'{fp} + {tn}', rows)} * 100, 6) AS pct_high, CAST({rows} AS bigint) AS n_records"
    )


# --- shared inputs -------------------------------------------------------------------------------------------


def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(raw_wide(spark, sf_dir))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.survey_long(tidy(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str, days: int = 16) -> DataFrame:
    return pipeline.classical_features(raw_wide(spark, sf_dir), days, None)


def features(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Labelled complete rows for model fitting."""
    return clean.drop_incomplete(match.label(matched(spark, sf_dir), threshold))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled complete rows, written once per query."""
    return io.materialise(features(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions-like frame: truth from labels, score from document length, group by language."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id", "inner"
    )
    score = 1 / (1 + F.col("n_chars") / 1000.0)
    return joined.select(
        "doc_id",
        "lang",
        "source",
        F.col("quality").alias("y_true"),
        "toxic",
        score.alias("y_prob"),
        F.when(score < 0.5, 1).otherwise(0).alias("y_pred"),
    )


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.cumulative_counts(curves.score_counts(scored(spark, sf_dir)))


def regression_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys with a raw prediction made from the matched NDVI."""
    complete = matched(spark, sf_dir).filter(F.col("NDVI").isNotNull())
    return complete.select(
        *RECORD_KEY, "Age", F.col("target").alias("raw_y_true"), (F.lit(50) * (1 + F.col("NDVI"))).alias("raw_y_pred")
    )


REGRESSION_SQL = f"""{MATCH_SQL},
regressed AS (SELECT ID, PixelID, SrvvR_Date, Age, target AS raw_y_true, 50 * (1 + NDVI) AS raw_y_pred
  FROM matched WHERE NDVI IS NOT NULL)"""

# --- sources, cleaning, reshape ------------------------------------------------------------------------------


@query("ingest_raw", f"{RAW_SQL} SELECT * REPLACE ({rounded(INDEX_COLS)}) FROM raw")
def ingest_raw(spark, sf_dir):
    path = io.scratch_dir(spark)
    io.save(raw_wide(spark, sf_dir), path)
    return io.ingest_raw(spark, path)


@query("projected_scan", "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS l_discount FROM lineitem")
def projected_scan(spark, sf_dir):
    return io.scan(spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_discount"])


CLEAN_COLS = ["ID", "PixelID", "Season", "Type", *RATE_COLS, *DATE_COLS, "ImgDate", "DOY"]


@query("clean_rules", f"{CLEAN_SQL} SELECT {listed(CLEAN_COLS)}, {rounded(INDEX_COLS + ['Density'])} FROM clean")
def clean_rules(spark, sf_dir):
    return tidy(spark, sf_dir)


def _rule_counts_sql() -> str:
    names = ["not_replanted", "indices_present", "not_before_planting", "indices_in_range"]
    kept = [" AND ".join(RULES_SQL[:i]) or "true" for i in range(5)]
    parts = [
        f"SELECT CAST({i} AS int) AS step, '{name}' AS rule, count(*) FILTER ({kept[i]}) AS kept, "
        f"count(*) FILTER ({kept[i - 1]}) - count(*) FILTER ({kept[i]}) AS removed FROM raw"
        for i, name in enumerate(names, 1)
    ]
    return f"{RAW_SQL} {' UNION ALL '.join(parts)}"


@query("clean_rule_counts", _rule_counts_sql())
def clean_rule_counts(spark, sf_dir):
    return clean.rule_counts(raw_wide(spark, sf_dir))


@query(
    "composition_class",
    f"{RAW_SQL} SELECT SpcsCmp, {CLASS_SQL} AS class, count(*) AS n FROM raw GROUP BY ALL",
)
def composition_class(spark, sf_dir):
    named = raw_wide(spark, sf_dir).groupBy("SpcsCmp").agg(F.count(F.lit(1)).alias("n"))
    return named.withColumn("class", scalar.composition_class(F.col("SpcsCmp")))


SURVEY_COLS = ["ID", "PixelID", "Type", "Season", "Age", "SrvvR_Date"]


@query("survey_rates", f"{SURVEY_SQL} SELECT ID, PixelID, Type, Season, Age, {rounded(['Density', 'target'])} FROM rates")
def survey_rates(spark, sf_dir):
    return reshape.survey_rates(reshape.site_rows(tidy(spark, sf_dir)))


@query("survey_dates", f"{SURVEY_SQL} SELECT * FROM dates")
def survey_dates(spark, sf_dir):
    return reshape.survey_dates(reshape.site_rows(tidy(spark, sf_dir)))


@query("survey_long", f"{SURVEY_SQL} SELECT {listed(SURVEY_COLS)}, {rounded(['Density', 'target'])} FROM survey")
def survey_long(spark, sf_dir):
    return surveys(spark, sf_dir)


OBS_COLS = ["ID", "PixelID", "ImgDate", "DOY"]


@query("observations", f"{TABLES_SQL} SELECT {listed(OBS_COLS)}, {rounded(INDEX_COLS)} FROM obs")
def observations(spark, sf_dir):
    return reshape.split_tables(tidy(spark, sf_dir))[1]


LOOKUP_COLS = ["ID", "PixelID", "SrvvR_Date", "Age", "Type"]


@query("lookup", f"{TABLES_SQL} SELECT {listed(LOOKUP_COLS)}, {rounded(['Density', 'target'])} FROM lookup")
def lookup(spark, sf_dir):
    return reshape.split_tables(tidy(spark, sf_dir))[0]


# --- window match and labels ---------------------------------------------------------------------------------


def _match_select(days: int) -> str:
    return f"{match_sql(days)} SELECT {listed(SURVEY_COLS)}, {rounded(['Density', 'target', *INDEX_COLS], digits=MEAN_DIGITS)} FROM matched"


@query("window_match_15", _match_select(15), MEAN_DIGITS)
def window_match_15(spark, sf_dir):
    return matched(spark, sf_dir, 15)


@query("window_match_16", _match_select(16), MEAN_DIGITS)
def window_match_16(spark, sf_dir):
    return matched(spark, sf_dir, 16)


@query(
    "window_match_by_date",
    f"""{TABLES_SQL},
means AS (SELECT s.ID, s.PixelID, s.Age, s.SrvvR_Date, {", ".join(f"avg(o.{c}) AS {c}" for c in INDEX_COLS)}
  FROM survey s JOIN obs o ON s.ID = o.ID AND s.PixelID = o.PixelID
   AND o.ImgDate BETWEEN s.SrvvR_Date - 16 AND s.SrvvR_Date + 16 GROUP BY ALL)
SELECT {listed(SURVEY_COLS, "s.")}, {rounded(['Density', 'target'], 's.', MEAN_DIGITS)}, {rounded(INDEX_COLS, 'm.', MEAN_DIGITS)}
FROM survey s LEFT JOIN means m USING (ID, PixelID, Age, SrvvR_Date)""",
    MEAN_DIGITS,
)
def window_match_by_date(spark, sf_dir):
    data = tidy(spark, sf_dir)
    seen = reshape.observations(data)
    return match.match_window(reshape.survey_long(data), seen, 16, key_by_date=True, dedupe=False)


@query(
    "label_thresholds",
    f"""{SURVEY_SQL} SELECT threshold, {listed(SURVEY_COLS)}, round(Density, 6) AS Density,
  CASE WHEN target < threshold THEN 0 ELSE 1 END AS target
FROM survey CROSS JOIN (VALUES {", ".join(f"({round(t * 100)})" for t in THRESHOLDS)}) t(threshold)""",
)
def label_thresholds(spark, sf_dir):
    return match.label_thresholds(surveys(spark, sf_dir))


@query(
    "threshold_partitions",
    f"""{SURVEY_SQL} SELECT threshold, CASE WHEN target < threshold THEN 0 ELSE 1 END AS target, count(*) AS n
FROM survey CROSS JOIN (VALUES {", ".join(f"({round(t * 100)})" for t in THRESHOLDS)}) t(threshold) GROUP BY ALL""",
)
def threshold_partitions(spark, sf_dir):
    path = io.scratch_dir(spark)
    io.save(match.label_thresholds(surveys(spark, sf_dir)), path, partition_by=["threshold"])
    return io.scan(spark, path).groupBy("threshold", "target").agg(F.count(F.lit(1)).alias("n"))


# --- quality and profiles ------------------------------------------------------------------------------------


@query(
    "quality_shares",
    f"""{RAW_SQL},
site AS (SELECT ID, avg(NmbrPlR) > 0 AS replanted, bool_or(prevUse IN ('AG', 'Fallow', 'Cash crop rotation', 'Pasture / hay production')) AS ag
  FROM raw GROUP BY ID),
pairs AS ({" UNION ".join(f"SELECT ID, {k} AS Age, SrvvR_{k} AS target FROM raw WHERE SrvvR_{k} IS NOT NULL" for k in AGES)})
SELECT round(100e0 * count(*) FILTER (NmbrPlR > 0) / count(*), 6) AS replanted_rows_pct,
  (SELECT round(100e0 * count(*) FILTER (replanted) / count(*), 6) FROM site) AS replanted_sites_pct,
  round(100e0 * (count(*) - count(*) FILTER ({RULES_SQL[3]})) / count(*), 6) AS out_of_range_pct,
  round(100e0 * (count(*) - count(*) FILTER ({RULES_SQL[1]})) / count(*), 6) AS missing_pct,
  round(100e0 * count(*) FILTER (Year < Season) / count(*), 6) AS pre_planting_pct,
  (SELECT round(1e0 * count(*) FILTER (ag) / count(*), 6) FROM site) AS agricultural_share,
  (SELECT round(100e0 * count(*) FILTER (target NOT BETWEEN 0 AND 100) / count(*), 6) FROM pairs) AS bad_survey_pct
FROM raw""",
)
def quality_shares(spark, sf_dir):
    return profile.quality_shares(raw_wide(spark, sf_dir))


def _missing_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", count({c}) AS present, count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) * 1e0 / count(*), 6) AS missing_share FROM raw"
        for c in RAW_SCHEMA.fieldNames()
    ]
    return f"{RAW_SQL} {' UNION ALL '.join(parts)}"


@query("missingness", _missing_sql())
def missingness(spark, sf_dir):
    return profile.missingness(raw_wide(spark, sf_dir))


CATEGORIES = {"part": ["p_brand", "p_type", "p_name"], "events": ["event_type", "props"]}


def _category_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CAST({c} AS varchar) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL"
        for t, cols in CATEGORIES.items()
        for c in cols
    ]
    return f"""WITH counts AS ({' UNION ALL '.join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value DESC) AS i FROM counts)
SELECT "column", count(*) AS classes, max(CASE WHEN i = 1 THEN value END) AS dominant,
  round(max(n) * 1e0 / sum(n), 6) AS dominant_share FROM ranked GROUP BY "column" """


@query("category_share", _category_sql())
def category_share(spark, sf_dir):
    parts = [({}, profile.category_share(table(spark, sf_dir, t), cols)) for t, cols in CATEGORIES.items()]
    return reshape.union_tagged(parts)


@query(
    "species_share",
    f"""{RAW_SQL}, counts AS (SELECT 'SpcsCmp' AS "column", SpcsCmp AS value, count(*) AS n FROM raw GROUP BY ALL
  UNION ALL SELECT 'prevUse', prevUse, count(*) FROM raw GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value DESC) AS i FROM counts)
SELECT "column", count(*) AS classes, max(CASE WHEN i = 1 THEN value END) AS dominant,
  round(max(n) * 1e0 / sum(n), 6) AS dominant_share FROM ranked GROUP BY "column" """,
)
def species_share(spark, sf_dir):
    return profile.category_share(raw_wide(spark, sf_dir), ["SpcsCmp", "prevUse"])


def _means(columns: list[str], digits: int = MEAN_DIGITS) -> str:
    return ", ".join(f"round(avg({c}), {digits}) + 0e0 AS {c}" for c in columns)


@query(
    "seasonal_profile",
    f"{CLEAN_SQL} SELECT CAST(month(ImgDate) AS int) AS month, count(*) AS n, {_means(INDEX_COLS)} FROM clean GROUP BY 1",
    MEAN_DIGITS,
)
def seasonal_profile(spark, sf_dir):
    return profile.seasonal_profile(tidy(spark, sf_dir))


@query("age_profile", f"{MATCH_SQL} SELECT Age, count(*) AS n, {_means(['target', *INDEX_COLS])} FROM matched GROUP BY Age", MEAN_DIGITS)
def age_profile(spark, sf_dir):
    return profile.mean_profile(matched(spark, sf_dir), ["Age"], ["target", *INDEX_COLS])


@query(
    "type_age_profile",
    f"{MATCH_SQL} SELECT Type, Age, count(*) AS n, {_means(['target', *INDEX_COLS])} FROM matched GROUP BY Type, Age",
    MEAN_DIGITS,
)
def type_age_profile(spark, sf_dir):
    return profile.mean_profile(matched(spark, sf_dir), ["Type", "Age"], ["target", *INDEX_COLS])


PAIRS = [(a, b) for i, a in enumerate(INDEX_COLS) for b in INDEX_COLS[i + 1 :]] + [(c, "target") for c in INDEX_COLS]


@query(
    "corr_by_age",
    f"{MATCH_SQL} "
    + " UNION ALL ".join(
        f"SELECT Age, '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM matched GROUP BY Age"
        for a, b in PAIRS
    ),
)
def corr_by_age(spark, sf_dir):
    return profile.correlations(matched(spark, sf_dir), PAIRS, ["Age"])


NUMERIC = ["Season", *RATE_COLS, "DOY", *INDEX_COLS, "Density"]


@query("group_numeric_mean", f"{CLEAN_SQL} SELECT ID, {_means(NUMERIC, 11)} FROM clean GROUP BY ID", 11)
def group_numeric_mean(spark, sf_dir):
    return profile.group_numeric_mean(tidy(spark, sf_dir), ["ID"])


# --- splits, folds, weights ----------------------------------------------------------------------------------


@query("group_split", f"{SPLIT_SQL} SELECT ID, r <= floor(0.7e0 * n) AS is_train, rows FROM ids JOIN (SELECT ID, count(*) AS rows FROM clean GROUP BY ID) USING (ID)")
def group_split(spark, sf_dir):
    marked = split.mark_train(tidy(spark, sf_dir))
    return marked.groupBy("ID", "is_train").agg(F.count(F.lit(1)).alias("rows"))


def _side_sql(test: str) -> str:
    return f"{SPLIT_SQL} SELECT ID, PixelID, ImgDate, DOY, {rounded(INDEX_COLS)} FROM clean JOIN ids USING (ID) WHERE {test}"


def side_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations of the training sites and of the rest; the clean rows are written once for cutoff and sides."""
    data = clean.clean(raw_wide(spark, sf_dir, together=False)).select(*OBS_COLS, *INDEX_COLS)
    return split.group_split(io.materialise(data))


@query("train_rows", _side_sql("r <= floor(0.7e0 * n)"))
def train_rows(spark, sf_dir):
    return side_rows(spark, sf_dir)[0]


@query("rest_rows", _side_sql("r > floor(0.7e0 * n)"))
def rest_rows(spark, sf_dir):
    return side_rows(spark, sf_dir)[1]


@query("complement", _side_sql("r > floor(0.7e0 * n)"))
def complement(spark, sf_dir):
    data = tidy(spark, sf_dir)
    train = split.group_split(data)[0]
    return reshape.complement(data, train, "ID").select(*OBS_COLS, *INDEX_COLS)


@query(
    "lookup_halves",
    f"""{TABLES_SQL}, ids AS (SELECT ID, row_number() OVER (ORDER BY md5(concat(ID, ':591'))) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT ID FROM lookup))
SELECT {listed(RECORD_KEY)}, Age, CASE WHEN r <= floor(0.5e0 * n) THEN 'test' ELSE 'valid' END AS side FROM lookup JOIN ids USING (ID)""",
)
def lookup_halves(spark, sf_dir):
    path = io.scratch_dir(spark)
    pipeline.write_halves(lookup(spark, sf_dir), path)
    sides = [({"side": s}, io.scan(spark, f"{path}/{s}_lookup", columns=[*RECORD_KEY, "Age"])) for s in ("test", "valid")]
    return reshape.union_tagged(sides)


@query(
    "group_folds",
    f"""{SPLIT_SQL}, folded AS (SELECT ID, CAST(ntile(5) OVER (ORDER BY r) - 1 AS int) AS fold FROM ids)
SELECT ID, PixelID, ImgDate, DOY, round(TCG, 6) AS TCG, fold FROM clean JOIN folded USING (ID)""",
)
def group_folds(spark, sf_dir):
    return split.group_folds(tidy(spark, sf_dir)).select(*OBS_COLS, "TCG", "fold")


@query(
    "balanced_folds",
    f"""WITH RECURSIVE {CLEAN_SQL.strip().removeprefix("WITH")},
sizes AS (SELECT size, row_number() OVER (ORDER BY size DESC, ID) AS i FROM (SELECT ID, count(*) AS size FROM clean GROUP BY ID)),
dealt AS (SELECT CAST(0 AS bigint) AS i, CAST(-1 AS bigint) AS fold, CAST(0 AS bigint) AS size, CAST([0, 0, 0, 0, 0] AS bigint[]) AS loads
  UNION ALL SELECT s.i, list_position(d.loads, list_min(d.loads)) - 1, s.size,
    [CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN d.loads[k] + s.size ELSE d.loads[k] END FOR k IN [1, 2, 3, 4, 5]]
  FROM dealt d JOIN sizes s ON s.i = d.i + 1)
SELECT CAST(fold AS int) AS fold, count(*) AS n_keys, CAST(sum(size) AS bigint) AS n_rows FROM dealt WHERE fold >= 0 GROUP BY fold""",
)
def balanced_folds(spark, sf_dir):
    folded = split.balanced_folds(tidy(spark, sf_dir).select("ID"))
    return folded.groupBy("fold").agg(F.count_distinct("ID").alias("n_keys"), F.count(F.lit(1)).alias("n_rows"))


LABELLED_SQL = f"{MATCH_SQL}, labelled AS (SELECT * REPLACE (CASE WHEN target < 70 THEN 0 ELSE 1 END AS target) FROM matched WHERE NDVI IS NOT NULL)"


@query(
    "class_weights",
    f"""{LABELLED_SQL}, counts AS (SELECT target, count(*) AS n FROM labelled GROUP BY target)
SELECT target, n, round((SELECT sum(n) FROM counts) * 1e0 / ((SELECT count(*) FROM counts) * n), 6) AS weight FROM counts""",
)
def class_weights(spark, sf_dir):
    return split.class_weights(features(spark, sf_dir))


@query(
    "weighted_rows",
    f"""{LABELLED_SQL}, counts AS (SELECT target, count(*) AS n FROM labelled GROUP BY target)
SELECT ID, PixelID, Age, target, round((SELECT sum(n) FROM counts) * 1e0 / ((SELECT count(*) FROM counts) * n), 6) AS weight
FROM labelled JOIN counts USING (target)""",
)
def weighted_rows(spark, sf_dir):
    return split.add_class_weights(features(spark, sf_dir)).select("ID", "PixelID", "Age", "target", "weight")


# --- metrics and curves --------------------------------------------------------------------------------------


@query("confusion", f"{SCORED_SQL} SELECT CAST(tp AS bigint) AS tp, CAST(fn AS bigint) AS fn, CAST(fp AS bigint) AS fp, CAST(tn AS bigint) AS tn FROM cells")
def confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir))


@query(
    "confusion_matrix",
    f"""{SCORED_SQL} SELECT 'True Low' AS "index", CAST(tp AS bigint) AS "Predicted Low", CAST(fn AS bigint) AS "Predicted High" FROM cells
UNION ALL SELECT 'True High', CAST(fp AS bigint), CAST(tn AS bigint) FROM cells""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(confusion(spark, sf_dir))


@query(
    "confusion_melt",
    f"""{SCORED_SQL} SELECT CASE y_true WHEN 0 THEN 'True Low' ELSE 'True High' END AS "True",
  CASE y_pred WHEN 0 THEN 'Predicted Low' ELSE 'Predicted High' END AS "Predicted", count(*) AS "Count" FROM scored GROUP BY ALL""",
)
def confusion_melt(spark, sf_dir):
    return metrics.melt_matrix(confusion_matrix(spark, sf_dir))


@query("class_metrics", f"{SCORED_SQL} SELECT {metric_columns()} FROM cells")
def class_metrics(spark, sf_dir):
    return metrics.class_metrics(confusion(spark, sf_dir), digits=DIGITS)


@query(
    "metrics_by_group",
    f"""{SCORED_SQL}, by_lang AS (SELECT lang, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fn,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tn FROM scored GROUP BY lang)
SELECT lang, {metric_columns()} FROM by_lang""",
)
def metrics_by_group(spark, sf_dir):
    return metrics.metrics_by_group(scored(spark, sf_dir), ["lang"], digits=DIGITS)


@query("rmse", f"{REGRESSION_SQL} SELECT round(sqrt(avg(pow(raw_y_true - raw_y_pred, 2))), 6) AS rmse FROM regressed")
def rmse(spark, sf_dir):
    return regression_frame(spark, sf_dir).agg(metrics.rmse(F.col("raw_y_true"), F.col("raw_y_pred")).alias("rmse"))


@query("log_loss", f"{SCORED_SQL} SELECT round(avg(CASE WHEN y_true = 0 THEN -ln(y_prob) ELSE -ln(1 - y_prob) END), 6) AS log_loss FROM scored")
def log_loss(spark, sf_dir):
    return scored(spark, sf_dir).agg(metrics.log_loss(F.col("y_true"), F.col("y_prob")).alias("log_loss"))


@query(
    "sequence_evaluation",
    f"""{REGRESSION_SQL}, labelled AS (SELECT *, CASE WHEN raw_y_true < 70 THEN 0 ELSE 1 END AS y_true,
  CASE WHEN raw_y_pred < 70 THEN 0 ELSE 1 END AS y_pred FROM regressed),
by_age AS (SELECT Age, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fn,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tn,
  round(sqrt(avg(pow(raw_y_true - raw_y_pred, 2))), 6) AS rmse FROM labelled GROUP BY Age)
SELECT Age, {metric_columns()}, rmse FROM by_age""",
)
def sequence_evaluation(spark, sf_dir):
    frame = regression_frame(spark, sf_dir).withColumns(
        {
            "y_true": scalar.below_threshold_label(F.col("raw_y_true"), 0.7),
            "y_pred": scalar.below_threshold_label(F.col("raw_y_pred"), 0.7),
        }
    )
    return metrics.metrics_by_group(frame, ["Age"], DIGITS, "raw_y_true", "raw_y_pred")


@query(
    "residuals",
    f"""{REGRESSION_SQL} SELECT ID, round(avg(Age), 6) AS Age, round(avg(raw_y_true), 6) AS raw_y_true,
  round(avg(raw_y_pred), 6) AS raw_y_pred, round(abs(avg(raw_y_true) - avg(raw_y_pred)), 6) AS residual FROM regressed GROUP BY ID""",
)
def residuals(spark, sf_dir):
    means = profile.group_numeric_mean(regression_frame(spark, sf_dir), ["ID"])
    return means.withColumn("residual", scalar.absolute_residual(F.col("raw_y_true"), F.col("raw_y_pred")))


@query(
    "roc_curve",
    f"""{CURVE_SQL} SELECT CAST('inf' AS double) AS threshold, 0e0 AS fpr, 0e0 AS tpr
UNION ALL SELECT round(score, 6), round(fp * 1e0 / n_neg, 6), round(tp * 1e0 / n_pos, 6) FROM cum
WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
)
def roc_curve(spark, sf_dir):
    return curves.roc_curve(cumulative(spark, sf_dir))


@query(
    "pr_curve",
    f"{CURVE_SQL} SELECT round(score, 6) AS threshold, round(tp * 1e0 / (tp + fp), 6) AS precision, round(tp * 1e0 / n_pos, 6) AS recall FROM cum",
)
def pr_curve(spark, sf_dir):
    return curves.pr_curve(cumulative(spark, sf_dir))


@query("auc", f"{CURVE_SQL} SELECT round(sum(neg * (2 * tp - pos) / 2e0) / max(n_pos * n_neg), 6) AS auc FROM cum")
def auc(spark, sf_dir):
    return curves.curve_scores(cumulative(spark, sf_dir)).select("auc")


@query("average_precision", f"{CURVE_SQL} SELECT round(sum(pos * 1e0 * tp / (tp + fp)) / max(n_pos), 6) AS ap FROM cum")
def average_precision(spark, sf_dir):
    return curves.curve_scores(cumulative(spark, sf_dir)).select("ap")


@query(
    "scores_by_group",
    """WITH scored AS (SELECT d.lang, l.quality AS y_true, 1 / (1 + d.n_chars / 1000e0) AS y_prob FROM documents d JOIN labels l USING (doc_id)),
counts AS (SELECT lang, y_prob AS score, count(*) FILTER (y_true = 0) AS pos, count(*) FILTER (y_true = 1) AS neg FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER w AS n_pos, sum(neg) OVER w AS n_neg FROM counts
  WINDOW w AS (PARTITION BY lang), d AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, round(sum(neg * (2 * tp - pos) / 2e0) / nullif(max(n_pos * n_neg), 0), 6) AS auc,
  round(sum(pos * 1e0 * tp / (tp + fp)) / nullif(max(n_pos), 0), 6) AS ap FROM cum GROUP BY lang""",
)
def scores_by_group(spark, sf_dir):
    counts = curves.score_counts(scored(spark, sf_dir), ["lang"])
    return curves.curve_scores(curves.cumulative_counts(counts, ["lang"]), ["lang"])


CURVE_FILES = [(50, "random_forest", "y_true", False), (80, "random_forest", "y_true", True), (50, "logistic_regression", "toxic", False)]


def _curve_files_sql() -> str:
    parts = []
    for threshold, model, truth, flip in CURVE_FILES:
        score = "1 - y_prob" if flip else "y_prob"
        title = model.replace("_", " ").title()
        parts.append(
            f"""SELECT '{threshold}%' AS "Threshold", '{title}' AS "Model", round(score, 6) AS threshold_value,
  round(tp * 1e0 / (tp + fp), 6) AS precision, round(tp * 1e0 / n_pos, 6) AS recall FROM (
  SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
    sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS n_pos FROM (
    SELECT {score} AS score, count(*) FILTER ({truth} = 0) AS pos, count(*) FILTER ({truth} = 1) AS neg FROM scored GROUP BY 1))"""
        )
    return f"{SCORED_SQL} {' UNION ALL '.join(parts)}"


@query("curve_files", _curve_files_sql())
def curve_files(spark, sf_dir):
    base = io.scratch_dir(spark)
    paths = []
    for threshold, model, truth, flip in CURVE_FILES:
        frame = scored(spark, sf_dir)
        frame = frame.withColumn("y_prob", 1 - F.col("y_prob")) if flip else frame
        running = curves.cumulative_counts(curves.score_counts(frame, truth=truth))
        paths.append(f"{base}/{threshold}/{model}_pr_curve")
        drawn = curves.pr_curve(running).withColumnRenamed("threshold", "threshold_value")
        io.save_csv(drawn.select("threshold_value", "precision", "recall"), paths[-1])
    schema = "threshold_value double, precision double, recall double"
    return io.with_path_labels(io.load_csv(spark, paths, schema), "pr_curve")


# --- sequences -----------------------------------------------------------------------------------------------


def sequence_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, observations), both written: statistics, sizes and histories read them, and the joins behind them move far more."""
    records, seen = reshape.split_tables(tidy(spark, sf_dir))
    return records, io.materialise(seen)


def sequence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.split_tables(tidy(spark, sf_dir))[0]


def _stats_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", round(m_{c}, 6) AS mean, round(s_{c}, 6) AS std FROM stats" for c in [*TASSELED_CAP, "Density"]
    ]
    return f"{TABLES_SQL} {' UNION ALL '.join(parts)}"


@query("norm_stats", _stats_sql())
def norm_stats(spark, sf_dir):
    records, seen = sequence_inputs(spark, sf_dir)
    path = io.scratch_dir(spark)
    stats = io.stats_for(spark, path, lambda: history.normalisation_stats(seen, records))
    return stats.select(F.explode(F.map_entries("mean")).alias("m"), "std").select(
        F.col("m.key").alias("column"), F.col("m.value").alias("mean"), F.col("std")[F.col("m.key")].alias("std")
    )


@query(
    "zscore",
    f"""{TABLES_SQL} SELECT {listed(OBS_COLS)}, {rounded(BOUNDED_INDICES)},
  {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in TASSELED_CAP)} FROM obs CROSS JOIN stats""",
)
def zscore(spark, sf_dir):
    records, seen = sequence_inputs(spark, sf_dir)
    return history.apply_stats(seen, history.normalisation_stats(seen, records), TASSELED_CAP)


@query(
    "onehot",
    f"""{TABLES_SQL} SELECT {listed(RECORD_KEY)}, Age, {rounded(['Density', 'target'])},
  CASE WHEN Type = 'Conifer' THEN 1 ELSE 0 END AS Type_Conifer, CASE WHEN Type = 'Decidous' THEN 1 ELSE 0 END AS Type_Decidous FROM lookup""",
)
def onehot(spark, sf_dir):
    return reshape.add_one_hot(sequence_records(spark, sf_dir), "Type", ["Conifer", "Decidous"])


STEP_COLS = ["log_dt", "neg_cos_DOY", *INDEX_COLS]


@query("history_long", f"{TABLES_SQL} SELECT {listed(RECORD_KEY)}, pos, {rounded(STEP_COLS)} FROM steps")
def history_long(spark, sf_dir):
    return history.history_long(*sequence_inputs(spark, sf_dir))


@query("history_len", f"{TABLES_SQL} SELECT * FROM lengths")
def history_len(spark, sf_dir):
    return history.history_length(history_long(spark, sf_dir))


@query(
    "drop_no_history",
    f"{TABLES_SQL} SELECT {listed(LOOKUP_COLS)}, {rounded(['Density', 'target'])} FROM lookup SEMI JOIN lengths USING (ID, PixelID, SrvvR_Date)",
)
def drop_no_history(spark, sf_dir):
    return history.with_history(*sequence_inputs(spark, sf_dir))


ZSTEPS = [f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" if c in TASSELED_CAP else f"round({c}, 6) AS {c}" for c in STEP_COLS]


@query("sequences", f"{TABLES_SQL} SELECT {listed(RECORD_KEY)}, pos, {', '.join(ZSTEPS)} FROM steps CROSS JOIN stats")
def sequences(spark, sf_dir):
    records, seen = sequence_inputs(spark, sf_dir)
    steps = history.sequence_tables(records, seen, history.normalisation_stats(seen, records))[1]
    return history.explode_steps(history.collect_steps(steps))


@query(
    "sequence_lookup",
    f"""{TABLES_SQL} SELECT {listed(RECORD_KEY)}, Age, round((Density - m_Density) / s_Density, 6) AS Density,
  CASE WHEN Type = 'Conifer' THEN 1 ELSE 0 END AS Type_Conifer, CASE WHEN Type = 'Decidous' THEN 1 ELSE 0 END AS Type_Decidous,
  concat(ID, '_', PixelID, '_', strftime(SrvvR_Date, '%Y-%m-%d'), '.parquet') AS filename, round(target, 6) AS target
FROM lookup SEMI JOIN lengths USING (ID, PixelID, SrvvR_Date) CROSS JOIN stats""",
)
def sequence_lookup(spark, sf_dir):
    records, seen = sequence_inputs(spark, sf_dir)
    return history.sequence_tables(records, seen, history.normalisation_stats(seen, records))[0]


@query(
    "sequence_summary",
    f"""{TABLES_SQL} SELECT {listed(RECORD_KEY)}, count(*) AS seq_len, """
    + ", ".join(
        f"round(arg_max({c}, pos), {MEAN_DIGITS}) + 0e0 AS {c}_last, round(avg({c}), {MEAN_DIGITS}) + 0e0 AS {c}_mean, round(min({c}), {MEAN_DIGITS}) + 0e0 AS {c}_min, "
        f"round(max({c}), {MEAN_DIGITS}) + 0e0 AS {c}_max, round(covar_pop({c}, 1 - exp(log_dt)) / nullif(var_pop(exp(log_dt) - 1) FILTER ({c} IS NOT NULL), 0), {MEAN_DIGITS}) + 0e0 AS {c}_slope, "
        f"round(sum({c} / exp(log_dt)) / sum(1 / exp(log_dt)) FILTER ({c} IS NOT NULL), {MEAN_DIGITS}) + 0e0 AS {c}_recent"
        for c in ["NDVI", "TCB"]
    )
    + " FROM steps GROUP BY ALL",
    MEAN_DIGITS,
)
def sequence_summary(spark, sf_dir):
    return history.summarise_steps(history_long(spark, sf_dir), ["NDVI", "TCB"])


@query(
    "fetch_steps",
    f"""{TABLES_SQL} SELECT {listed(RECORD_KEY)}, coalesce(pos, 1) AS pos, round(coalesce(log_dt, 0), 6) AS log_dt, round(coalesce(NDVI, 0), 6) AS NDVI
FROM records LEFT JOIN steps USING (ID, PixelID, SrvvR_Date)""",
)
def fetch_steps(spark, sf_dir):
    records, seen = sequence_inputs(spark, sf_dir)
    keys = records.select(*RECORD_KEY).dropDuplicates()
    return batching.fetch_steps(keys, history.history_long(records, seen), features=["log_dt", "NDVI"])


SHUFFLE_SQL = f"""{TABLES_SQL},
shuffled AS (SELECT *, row_number() OVER (ORDER BY Age, md5(concat(ID, ':', PixelID, ':', strftime(SrvvR_Date, '%Y-%m-%d'), ':', Age, ':591:0'))) - 1 AS position
  FROM (SELECT DISTINCT ID, PixelID, SrvvR_Date, Age FROM lookup)),
batched AS (SELECT *, CAST(floor(position / 64) AS bigint) AS batch FROM shuffled)"""


def shuffled(records: DataFrame) -> DataFrame:
    return batching.shuffle_in_group(records.select(*RECORD_KEY, "Age").dropDuplicates(), [*RECORD_KEY, "Age"])


def batched(records: DataFrame) -> DataFrame:
    return batching.assign_batches(shuffled(records), 64)


@query("shuffle_in_group", f"{SHUFFLE_SQL} SELECT * FROM shuffled")
def shuffle_in_group(spark, sf_dir):
    return shuffled(sequence_records(spark, sf_dir))


@query("batches", f"{SHUFFLE_SQL} SELECT * FROM batched")
def batches(spark, sf_dir):
    return batched(sequence_records(spark, sf_dir))


@query(
    "padded",
    f"""{SHUFFLE_SQL},
sized AS (SELECT b.*, coalesce(seq_len, 1) AS sequence_length FROM batched b LEFT JOIN lengths USING (ID, PixelID, SrvvR_Date)),
grid AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY sequence_length DESC, position) AS batch_row,
  max(sequence_length) OVER (PARTITION BY batch) AS longest FROM sized),
cells AS (SELECT *, unnest(range(1, longest + 1)) AS pos FROM grid)
SELECT {listed(RECORD_KEY, "c.")}, batch, CAST(batch_row AS int) AS batch_row, sequence_length, c.pos, {", ".join(f"round(coalesce(s.{c}, 0), 6) + 0e0 AS {c}" for c in STEP_COLS)}
FROM cells c LEFT JOIN steps s ON c.ID = s.ID AND c.PixelID = s.PixelID AND c.SrvvR_Date = s.SrvvR_Date AND c.pos = s.pos""",
)
def padded(spark, sf_dir):
    records, seen = sequence_inputs(spark, sf_dir)
    # The steps are read for their lengths and for their values, so they are written once.
    return batching.pad_batches(batched(records), io.materialise(history.history_long(records, seen)))


# --- contributions, selection, stopping ----------------------------------------------------------------------

BETA = {"Density": 0.002, "NDVI": 1.5, "SAVI": -0.75, "TCB": 0.05, "TCG": -0.01, "TCW": 0.3}
CONTRIB_SQL = f"""{LABELLED_SQL},
centre AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in BETA)} FROM labelled),
phi AS (SELECT ID, PixelID, SrvvR_Date, Age, {", ".join(f"{b} * ({c} - m_{c}) AS phi_{c}" for c, b in BETA.items())},
  0.25 + {" + ".join(f"{b} * m_{c}" for c, b in BETA.items())} AS base FROM labelled CROSS JOIN centre),
weight AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs(phi_{c})) AS importance FROM phi" for c in BETA)})"""
PHI = [f"phi_{c}" for c in BETA]


@query("linear_contributions", f"{CONTRIB_SQL} SELECT ID, PixelID, SrvvR_Date, Age, {rounded([*PHI, 'base'])} FROM phi")
def linear_contributions(spark, sf_dir):
    explained = importance.linear_contributions(features(spark, sf_dir), BETA, 0.25)
    return explained.select(*RECORD_KEY, "Age", *PHI, "base")


@query("mean_abs", f"{CONTRIB_SQL} SELECT feature, round(importance, 6) AS importance FROM weight")
def mean_abs(spark, sf_dir):
    return importance.mean_absolute(linear_contributions(spark, sf_dir), dict(zip(BETA, PHI)))


@query(
    "topk_keep",
    f"""{CONTRIB_SQL} SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS int) AS position
FROM weight WHERE feature NOT IN ('Density', 'TCW') QUALIFY position <= 3
UNION ALL SELECT feature, round(importance, 6), CASE feature WHEN 'TCW' THEN 4 ELSE 5 END FROM weight WHERE feature IN ('Density', 'TCW')""",
)
def topk_keep(spark, sf_dir):
    return importance.top_features(mean_abs(spark, sf_dir), 3, ["TCW", "Density"])


@query(
    "perm_ci",
    f"""{SCORED_SQL}, repeats AS (SELECT lang, source, avg(y_true) AS score FROM scored GROUP BY ALL),
moments AS (SELECT lang, avg(score) AS mean, stddev_pop(score) AS std FROM repeats GROUP BY lang)
SELECT lang, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - 1.96 * std / sqrt(5), 6) AS ci_lower,
  round(mean + 1.96 * std / sqrt(5), 6) AS ci_upper FROM moments""",
)
def perm_ci(spark, sf_dir):
    repeats = scored(spark, sf_dir).groupBy("lang", "source").agg(F.avg("y_true").alias("score"))
    return importance.confidence_interval(repeats, ["lang"], "score")


@query(
    "cv_best",
    """WITH scores AS (SELECT o_orderpriority AS config, month(o_orderdate) AS fold, avg(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT config, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM scores GROUP BY config ORDER BY avg(score) DESC LIMIT 1""",
)
def cv_best(spark, sf_dir):
    scores = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("config"), F.month("o_orderdate").alias("fold"))
        .agg(F.avg("o_totalprice").alias("score"))
    )
    summary = scores.groupBy("config").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )
    return importance.best_row(summary, "mean_score", "config")


@query(
    "early_stop",
    """WITH losses AS (SELECT o_orderpriority AS run, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS int) AS epoch,
  round(avg(o_totalprice), 2) AS loss FROM orders GROUP BY ALL),
w AS (SELECT *, coalesce(loss > lag(loss) OVER (PARTITION BY run ORDER BY epoch) * (1 + 1e-5), false) AS worse FROM losses),
g AS (SELECT *, sum(CASE WHEN worse THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY epoch) AS streak FROM w),
c AS (SELECT *, sum(CASE WHEN worse THEN 1 ELSE 0 END) OVER (PARTITION BY run, streak ORDER BY epoch) AS n FROM g),
s AS (SELECT run, coalesce(min(epoch) FILTER (n >= 3), max(epoch)) AS stop_step FROM c GROUP BY run)
SELECT run, stop_step, arg_min(epoch, loss) AS best_step, round(min(loss), 6) AS best_loss FROM losses JOIN s USING (run)
WHERE epoch <= stop_step GROUP BY ALL""",
)
def early_stop(spark, sf_dir):
    epoch = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch")
    losses = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("run"), epoch)
        .agg(F.round(F.avg("o_totalprice"), 2).alias("loss"))
    )
    return importance.early_stop(losses, 3, ["run"])


# --- models --------------------------------------------------------------------------------------------------

FOREST = {"n_estimators": 100, "max_depth": 8, "class_weight": "balanced"}
BOOSTED = {"n_estimators": 20, "max_depth": 4}

FEATURES_SQL = f"""{MATCH_SQL},
features AS (SELECT *, CASE WHEN target < 70 THEN 0 ELSE 1 END AS y FROM matched WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*SURVEY_COLS, "Density", "target", *INDEX_COLS])}),
feature_ids AS (SELECT ID, row_number() OVER (ORDER BY md5(concat(ID, ':591'))) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT ID FROM features))"""
NO_FAULTS = "CAST(0 AS bigint) AS repeated, CAST(0 AS bigint) AS outside, CAST(0 AS bigint) AS disagreeing"


def prediction_facts(predicted: DataFrame, by: list[str]) -> DataFrame:
    """Rows, sites and class-0 rows, and what must be 0: repeated records, probabilities outside 0..1, classes that
    are not the likelier one."""
    outside = ~F.col("y_prob").between(0, 1) | F.isnan("y_prob")
    disagreeing = F.col("y_pred") != F.when(F.col("y_prob") >= 0.5, 0).otherwise(1)
    return predicted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("ID").alias("n_sites"),
        F.count_if(F.col("y_true") == 0).alias("n_low"),
        (F.count(F.lit(1)) - F.count_distinct(*evaluate.RECORD)).alias("repeated"),
        F.count_if(outside).alias("outside"),
        F.count_if(disagreeing).alias("disagreeing"),
    )


OOF_SQL = f"""{FEATURES_SQL}, folded AS (SELECT ID, CAST(ntile(5) OVER (ORDER BY r) - 1 AS int) AS fold FROM feature_ids)
SELECT fold, count(*) AS n_rows, count(DISTINCT ID) AS n_sites, count(*) FILTER (y = 0) AS n_low, {NO_FAULTS}
FROM features JOIN folded USING (ID) GROUP BY fold"""


@query("lr_oof", OOF_SQL)
def lr_oof(spark, sf_dir):
    return prediction_facts(evaluate.out_of_fold(models.build_logistic_regression(), model_rows(spark, sf_dir)), ["fold"])


@query("rf_oof", OOF_SQL)
def rf_oof(spark, sf_dir):
    return prediction_facts(evaluate.out_of_fold(models.build_random_forest(**FOREST), model_rows(spark, sf_dir)), ["fold"])


@query("gbt_oof", OOF_SQL)
def gbt_oof(spark, sf_dir):
    return prediction_facts(evaluate.out_of_fold(models.build_gradient_boosting(**BOOSTED), model_rows(spark, sf_dir)), ["fold"])


@query(
    "hold_out_metrics",
    f"""{FEATURES_SQL} SELECT count(*) AS n_rows, count(DISTINCT ID) AS n_sites, count(*) FILTER (y = 0) AS n_low, {NO_FAULTS},
count(*) AS n_records, CAST(0 AS bigint) AS bad_scores FROM features JOIN feature_ids USING (ID) WHERE r > floor(0.7e0 * n)""",
)
def hold_out_metrics(spark, sf_dir):
    train, test = split.group_split(model_rows(spark, sf_dir))
    held = io.materialise(evaluate.hold_out(models.build_random_forest(**FOREST), train, test))
    scores = evaluate.evaluation(held)
    shares = ["f1", "f2", "precision", "recall", "accuracy", "auc", "ap"]
    bad = sum((~F.coalesce(F.col(c).between(0, 1), F.lit(False))).cast("long") for c in shares)
    return prediction_facts(held, []).crossJoin(scores.select("n_records", bad.alias("bad_scores")))


@query("model_reload", f"{FEATURES_SQL} SELECT count(*) AS n_rows, CAST(0 AS bigint) AS changed FROM features")
def model_reload(spark, sf_dir):
    path = io.scratch_dir(spark)
    rows = io.materialise(evaluate.numbered(model_rows(spark, sf_dir).dropna()))
    model = models.fit(models.build_random_forest(**FOREST), rows)
    model.save(path)
    before = evaluate.predictions(model, rows)
    after = evaluate.predictions(models.FittedModel.load(path), rows).select(*evaluate.RECORD, F.struct("y_pred", "y_prob").alias("after"))
    changed = F.count_if(~F.struct("y_pred", "y_prob").eqNullSafe(F.col("after")))
    return before.join(after, evaluate.RECORD, "left").agg(F.count(F.lit(1)).alias("n_rows"), changed.alias("changed"))


def fold_facts(experiments: DataFrame) -> DataFrame:
    """Fits by fold, and how many have a score outside 0..1."""
    bad = ~F.coalesce(F.col("score").between(0, 1), F.lit(False))
    return experiments.groupBy("fold").agg(F.count(F.lit(1)).alias("fits"), F.count_if(bad).alias("bad_scores"))


def fold_sql(configs: int) -> str:
    """Every configuration is fitted once in every fold that has sites."""
    return f"""{FEATURES_SQL}, folded AS (SELECT CAST(ntile(5) OVER (ORDER BY r) - 1 AS int) AS fold FROM feature_ids)
SELECT DISTINCT fold, CAST({configs} AS bigint) AS fits, CAST(0 AS bigint) AS bad_scores FROM folded"""


@query("search_log", fold_sql(3))
def search_log(spark, sf_dir):
    space = {"n_estimators": search.RandInt(20, 40), "max_depth": search.RandInt(1, 5), "class_weight": ["balanced", None]}
    spec = models.build_random_forest()
    found = search.search(spec, model_rows(spark, sf_dir), space, "random", 3, return_results=True)
    return fold_facts(found["experiments"])


@query("grid_experiments", fold_sql(4))
def grid_experiments(spark, sf_dir):
    space = {"C": [0.01, 1.0], "penalty": ["l2", "l1"]}
    rows = model_rows(spark, sf_dir)
    configs = search.grid_configs(space)
    records = search.cross_validate(models.build_logistic_regression(), rows, configs)
    return fold_facts(search.experiment_table(rows, records, configs))


TYPES_SQL = "(SELECT count(DISTINCT Type) FROM features)"


@query(
    "rfe",
    f"""{FEATURES_SQL}, size AS (SELECT {len(INDEX_COLS) + 2} + {TYPES_SQL} AS n), ranks AS (SELECT n, unnest(generate_series(1, 1 + CAST(ceil((n - 4) / 4e0) AS int))) AS rank FROM size)
SELECT CAST(rank AS int) AS rank, CAST(CASE WHEN rank = 1 THEN 4 WHEN rank = 2 THEN n - 4 - 4 * (ceil((n - 4) / 4e0) - 1) ELSE 4 END AS bigint) AS features,
CAST(CASE WHEN rank = 1 THEN 4 ELSE 0 END AS bigint) AS selected FROM ranks""",
)
def rfe(spark, sf_dir):
    spec = models.build_random_forest(models.Selection("RFE", 4, 4), **FOREST)
    ranked = select.rank_features(spec, model_rows(spark, sf_dir))
    return ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("features"), F.count_if("selected").alias("selected"))


@query("rfecv", f"{FEATURES_SQL} SELECT CAST({len(INDEX_COLS) + 2} + {TYPES_SQL} AS bigint) AS features, CAST(0 AS bigint) AS too_few, CAST(0 AS bigint) AS not_first")
def rfecv(spark, sf_dir):
    spec = models.build_logistic_regression(models.Selection("RFECV", step=3))
    ranked = select.rank_features(spec, model_rows(spark, sf_dir))
    return ranked.agg(
        F.count_distinct("feature").alias("features"),
        F.greatest(F.lit(6) - F.count_if("selected"), F.lit(0)).cast("long").alias("too_few"),
        F.count_if(F.col("selected") != (F.col("rank") == 1)).alias("not_first"),
    )


@query("perm_importance", f"{FEATURES_SQL} SELECT CAST({len(INDEX_COLS) + 3} + {TYPES_SQL} AS bigint) AS features, CAST(5 * ({len(INDEX_COLS) + 3} + {TYPES_SQL}) AS bigint) AS scores, CAST(0 AS bigint) AS constant_moved")
def perm_importance(spark, sf_dir):
    """With a constant among the features, which no permutation can change."""
    selector = ml_importance.ImportanceSelector(models.build_random_forest(**FOREST), "permute")
    rows = model_rows(spark, sf_dir).withColumn("always", F.lit(1.0))
    scores = selector.fit(rows).values
    moved = (F.col("feature") == "always") & (F.col("importance") != 0)
    return scores.agg(F.count_distinct("feature").alias("features"), F.count(F.lit(1)).alias("scores"), F.count_if(moved).alias("constant_moved"))


@query("selector_features", f"{FEATURES_SQL} SELECT count(*) AS n_rows, count(DISTINCT ID) AS n_sites, CAST(0 AS bigint) AS kept_missing FROM features")
def selector_features(spark, sf_dir):
    selector = ml_importance.ImportanceSelector(models.build_logistic_regression(), "SHAP", 3, keep_features=["NDVI", "TCB"], scaler=True)
    rows = model_rows(spark, sf_dir)
    found = selector.fit(rows)
    missing = len({"NDVI", "TCB"} - set(found.selected_features))
    return found.transform(rows).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ID").alias("n_sites"), F.lit(missing).cast("long").alias("kept_missing"))


def sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, seen = sequence_inputs(spark, sf_dir)
    tables = history.sequence_tables(records, seen, history.normalisation_stats(seen, records))
    return io.materialise(seqreg.sequence_features(*tables))


@query(
    "seq_regression",
    f"""{TABLES_SQL}, rows AS (SELECT * FROM lookup SEMI JOIN lengths USING (ID, PixelID, SrvvR_Date)),
row_ids AS (SELECT ID, row_number() OVER (ORDER BY md5(concat(ID, ':591'))) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT ID FROM rows))
SELECT Age, count(*) AS n_rows, round(avg(target), 6) + 0e0 AS mean_true, CAST(0 AS bigint) AS outside
FROM rows JOIN row_ids USING (ID) WHERE r > floor(0.7e0 * n) GROUP BY Age""",
)
def seq_regression(spark, sf_dir):
    train, test = split.group_split(sequence_rows(spark, sf_dir))
    predicted = seqreg.SequenceRegressor(True).fit(train).predict(test)
    outside = ~F.coalesce(F.col("raw_y_pred").between(0, 100), F.lit(False))
    return predicted.groupBy("Age").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("raw_y_true").alias("mean_true"), F.count_if(outside).alias("outside"))


@query("flagship", f"{MATCH_SQL} SELECT {listed(SURVEY_COLS)}, {rounded(['Density', *INDEX_COLS], digits=MEAN_DIGITS)}, CASE WHEN target < 70 THEN 0 ELSE 1 END AS target FROM matched", MEAN_DIGITS)
def flagship(spark, sf_dir):
    return pipeline.classical_features(raw_wide(spark, sf_dir), 16, 0.7)
