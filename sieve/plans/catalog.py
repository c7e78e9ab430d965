"""Registered queries (Spark) and their SQL oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables; ``ORACLES[name]`` is the DuckDB SQL computing the same relation.
Queries without an oracle (model fits) are checked by unit tests instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import class_name, decide
from pyspark.ml.functions import array_to_vector, vector_to_array
from ..operators import linear_grid as lg
from ..operators import neighbors as nb
from ..sources import adapters as ad
from . import sql_views as sv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OPT_THRESHOLD = 0.39        # fixed value: decision threshold of the final model


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --------------------------------------------------------------------------- V8 W2 J8
_SQL_KNN = _with(sv.scored()) + f"""
, pairs AS (
  SELECT q.record_id AS query_id, q.p AS qp, r.record_id AS ref_id, r.y AS ref_y,
         {sv.cosine('q.embedding', 'r.embedding')} AS cos
  FROM scored q JOIN scored r ON q.split = 'test' AND r.split = 'train'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, ref_id) AS rank FROM pairs)
SELECT query_id, qp AS query_p, CAST(qp >= {OPT_THRESHOLD} AS INTEGER) AS query_call, CAST(rank AS INTEGER) AS rank,
       ref_id, CASE WHEN ref_y = 1 THEN 'induction' ELSE 'inhibition' END AS neighbour_label,
       round(cos, 6) AS cosine
FROM ranked WHERE rank <= 3"""


def _knn(spark, sf_dir, **options):
    s = ad.scored(spark, sf_dir)
    q = s.filter(F.col("split") == "test")
    r = s.filter(F.col("split") == "train")
    # block sizes from the split counts of the shared scored table (no extra copies)
    top = nb.knn_topk(q.select("record_id", "embedding"), r.select("record_id", "embedding"), k=3,
                      n_queries=q.count(), n_refs=r.count(), **options)
    return (top.join(q.select(F.col("record_id").alias("query_id"), F.col("p").alias("query_p")), "query_id")
               .join(r.select(F.col("record_id").alias("ref_id"), F.col("y").alias("ref_y")), "ref_id")
               .select("query_id", "query_p", decide("query_p", OPT_THRESHOLD).alias("query_call"), "rank",
                       "ref_id", class_name("ref_y").alias("neighbour_label"),
                       F.round("cosine", 6).alias("cosine")))


@register("knn_top3", _SQL_KNN)
def knn_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir)


@register("knn_pruned", _SQL_KNN)
def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours through coarse clusters at any size: only clusters whose
    bound reaches a query's third cosine are visited."""
    return _knn(spark, sf_dir, prune_from=0)


@register("knn_lsh")
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest references of two large sides through a locality-sensitive join whose
    width follows from the wanted recall (0.95 of the three nearest)."""
    from ..operators.lsh import approx_topk
    s = ad.scored(spark, sf_dir).select("record_id", "embedding", "split")
    return approx_topk(s.filter(F.col("split") == "test"), s.filter(F.col("split") == "train"), k=3)


# --------------------------------------------------------------------------- P1-P12, P17, P21
from ..functions import serialize as ser  # noqa: E402
from ..functions import text as tx  # noqa: E402
from ..operators import clean as cl  # noqa: E402
from ..operators import encode as en  # noqa: E402

REC_COLS = ("lang", "source", "n_chars", "text", "region")   # 'region' is absent -> 'Unknown'


def _nm(c: str) -> str:
    return sv.normalize_missing(c)


@register("clean_missing", _with(sv.records()) + f"""
SELECT record_id, target, {_nm('lang')} AS lang, {_nm('source')} AS source, {_nm('n_chars')} AS n_chars,
       {_nm('text')} AS text, 'Unknown' AS region
FROM records""")
def clean_missing(spark, sf_dir):
    return cl.clean(ad.records(spark, sf_dir), REC_COLS, mode="train")


@register("clean_names", _with(sv.records()) + f"""
SELECT record_id, {sv.clean_name('text')} AS name FROM records""")
def clean_names(spark, sf_dir):
    return ad.texts(spark, sf_dir).select("record_id", tx.clean_name("text").alias("name"))


@register("clean_tags", _with(sv.records()) + f"""
SELECT record_id, {sv.clean_tag('text')} AS tag FROM records""")
def clean_tags(spark, sf_dir):
    return ad.texts(spark, sf_dir).select("record_id", tx.clean_tag("text").alias("tag"))


@register("clean_all", _with(sv.records()) + f"""
SELECT record_id, target, {_nm('lang')} AS lang, {sv.clean_name(_nm('source'))} AS source,
       {_nm('n_chars')} AS n_chars, {sv.clean_tag(_nm('text'))} AS text, 'Unknown' AS region
FROM records""")
def clean_all(spark, sf_dir):
    return cl.clean(ad.records(spark, sf_dir), REC_COLS, name_col="source", tag_col="text", mode="score")


@register("drop_unlabelled", _with(sv.records()) + """
SELECT record_id, lang, source, CAST(target AS INTEGER) AS target FROM records WHERE target IS NOT NULL""")
def drop_unlabelled(spark, sf_dir):
    return cl.labelled(ad.records(spark, sf_dir).select("record_id", "lang", "source", "target"))


@register("valid_records", _with(sv.parts()) + f"""
SELECT record_id, name FROM (SELECT record_id, {sv.clean_name(_nm('p_name'))} AS name FROM parts)
WHERE length(name) > 2 AND name <> 'Unknown'""")
def valid_records(spark, sf_dir):
    p = ad.parts(spark, sf_dir).select("record_id", tx.clean_name(tx.normalize_missing("p_name")).alias("name"))
    return cl.valid(p, "name")


@register("label_presence", _with(sv.records()) + """
SELECT source, CAST(max(CAST(target IS NOT NULL AS INTEGER)) AS INTEGER) AS has_label,
       count(target) AS n_labelled
FROM records GROUP BY source""")
def label_presence(spark, sf_dir):
    return cl.has_any_label(ad.records(spark, sf_dir), "target", ["source"])


REC_FIELDS = (("lang", "Language"), ("source", "Source"), ("region", "Region"),
              ("n_chars", "Length"), ("text", "Text"))


@register("serialize_optional", _with(sv.records()) + f"""
SELECT record_id, 'Language: ' || {_nm('lang')} || '. Source: ' || {_nm('source')} || '. Length: ' ||
       {_nm('n_chars')} || '. Text: ' || {_nm('text')} || '.' AS sentence
FROM records""")
def serialize_optional(spark, sf_dir):
    r = cl.clean(ad.texts(spark, sf_dir), ("lang", "source", "n_chars", "text"), mode="train")
    # 'region' is not a column of this table, so its field is skipped
    return r.select("record_id", ser.serialize_optional(r, REC_FIELDS).alias("sentence"))


PART_FIELDS = (("p_name", "Name"), ("p_brand", "Brand"), ("p_type", "Type"), ("p_size", "Size"))


@register("serialize_required", _with(sv.parts()) + """
SELECT record_id, 'Name: ' || p_name || '. Brand: ' || p_brand || '. Type: ' || p_type || '. Size: ' ||
       CAST(p_size AS VARCHAR) || '.' AS sentence
FROM parts""")
def serialize_required(spark, sf_dir):
    return ad.parts(spark, sf_dir).select("record_id", ser.serialize_required(PART_FIELDS).alias("sentence"))


def _disp(e: str, width: int | None = None) -> str:
    s = sv.strip_ws(f"coalesce(CAST({e} AS VARCHAR), 'ND')")
    return f"substring({s}, 1, {width})" if width else s


@register("truncate_display", _with(sv.records()) + f"""
SELECT record_id, {_disp('text', tx.METABOLITE_WIDTH)} AS text_60, {_disp('source', tx.MICROORGANISM_WIDTH)} AS source_45,
       {_disp('target')} AS target_text
FROM records""")
def truncate_display(spark, sf_dir):
    r = ad.records(spark, sf_dir)
    return r.select("record_id", tx.display_text("text", tx.METABOLITE_WIDTH).alias("text_60"),
                    tx.display_text("source", tx.MICROORGANISM_WIDTH).alias("source_45"),
                    tx.display_text("target").alias("target_text"))


@register("label_suffix", _with(sv.vectors()) + """
SELECT record_id, CAST(record_id AS VARCHAR) || CASE WHEN split = 'test' THEN ' (val.)' ELSE '' END AS label
FROM vectors""")
def label_suffix(spark, sf_dir):
    v = ad.vectors(spark, sf_dir)
    return v.select("record_id", ser.label_suffix(F.col("record_id").cast("string"), "split", "test", " (val.)")
                    .alias("label"))


# --------------------------------------------------------------------------- V2 V3 V4
def _tok(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), {sv.lit(en.NON_WORD)}), lambda t: t <> '')"


@register("token_profile", _with(sv.records()) + f"""
, tp AS (SELECT record_id, lang, len({_tok('text')}) AS n_tokens FROM records)
SELECT lang, count(*) AS n_records, CAST(min(n_tokens) AS INTEGER) AS min_tokens, CAST(max(n_tokens) AS INTEGER) AS max_tokens,
       avg(n_tokens) AS avg_tokens, CAST(sum(CAST(n_tokens > {en.MAX_TOKENS} AS INTEGER)) AS BIGINT) AS n_over_cap
FROM tp GROUP BY lang""")
def token_profile(spark, sf_dir):
    tp = en.token_profile(ad.texts(spark, sf_dir), carry=["lang"])
    return tp.groupBy("lang").agg(F.count(F.lit(1)).alias("n_records"), F.min("n_tokens").alias("min_tokens"),
                                  F.max("n_tokens").alias("max_tokens"), F.avg("n_tokens").alias("avg_tokens"),
                                  F.sum("over_cap").cast("long").alias("n_over_cap"))


@register("mean_pool_hash", _with(sv.records()) + f"""
, toks AS (SELECT record_id, unnest({_tok('text')}) AS tok FROM records),
ntok AS (SELECT record_id, len({_tok('text')}) AS n_tokens FROM records),
per AS (SELECT record_id, CAST({sv.md5_long('tok')} % {en.HASH_DIM} AS INTEGER) AS dim, count(*) AS cnt
        FROM toks GROUP BY ALL)
SELECT per.record_id, dim, cnt / n_tokens AS weight FROM per JOIN ntok USING (record_id)""")
def mean_pool_hash(spark, sf_dir):
    return en.hashed_mean_pool(ad.texts(spark, sf_dir).select("record_id", "text"))


@register("standardize_stats", _with(sv.vectors()) + """
, el AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM vectors WHERE split = 'train')
SELECT CAST(dim AS INTEGER) AS dim, avg(x) AS mean, stddev_pop(x) AS sd_pop,
       CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS scale
FROM el GROUP BY dim""")
def standardize_stats(spark, sf_dir):
    from ..operators.features import column_moments
    v = ad.vectors(spark, sf_dir).filter(F.col("split") == "train")
    return column_moments(v, "embedding")


# --------------------------------------------------------------------------- R1-R5
from ..operators import metrics as mt  # noqa: E402
from ..operators import resample as rs  # noqa: E402
from ..operators import selection as sel  # noqa: E402
from ..operators import split as sp  # noqa: E402
from ..operators import thresholds as th  # noqa: E402


@register("holdout_split", _with(sv.vectors()) + """
SELECT record_id, y, split FROM vectors""")
def holdout_split(spark, sf_dir):
    return ad.vectors(spark, sf_dir).select("record_id", "y", "split")


@register("kfold_assign", _with(sv.vectors()) + ", kf_src AS (SELECT record_id, y FROM vectors WHERE split = 'train'),\n"
          + sv.kfold("kf_src", "kf", sp.CV_SEEDS, sp.CV_FOLDS) + """
SELECT seed, record_id, y, fold FROM kf""")
def kfold_assign(spark, sf_dir):
    v = ad.vectors(spark, sf_dir).filter(F.col("split") == "train").select("record_id", "y")
    return sp.stratified_kfold(v).select("seed", "record_id", "y", "fold")


_RSEEDS = [sp.SPLIT_SEED * 1000 + r for r in range(sp.OOF_REPEATS)]


@register("repeated_kfold", _with(sv.vectors()) + ", rk_src AS (SELECT record_id, y FROM vectors),\n"
          + sv.kfold("rk_src", "rk", _RSEEDS, sp.OOF_FOLDS, seed_col="rseed") + f"""
SELECT CAST(rseed - {sp.SPLIT_SEED * 1000} AS INTEGER) AS repeat, fold, record_id, y FROM rk""")
def repeated_kfold(spark, sf_dir):
    v = ad.vectors(spark, sf_dir).select("record_id", "y")
    return sp.repeated_kfold(v).select("repeat", "fold", "record_id", "y")


@register("bootstrap_counts", _with(sv.vectors(), sv.boot_counts()) + "SELECT * FROM bcounts")
def bootstrap_counts(spark, sf_dir):
    return ad.boot_counts(spark, sf_dir)


# --------------------------------------------------------------------------- A1 A3-A7 A9 A10 A17
_T = f"{OPT_THRESHOLD}::DOUBLE"


def _sql_confusion(src: str, g: str, t: str = _T) -> str:
    return f"""SELECT {g}, tp, fp, fn, tn,
       CASE WHEN tp+fp+fn+tn = 0 THEN 0.0 ELSE CAST(tp+tn AS DOUBLE) / CAST(tp+fp+fn+tn AS DOUBLE) END AS accuracy,
       CASE WHEN tp+fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp+fp AS DOUBLE) END AS precision,
       CASE WHEN tp+fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp+fn AS DOUBLE) END AS recall,
       CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE CAST(2*tp AS DOUBLE) / CAST(2*tp+fp+fn AS DOUBLE) END AS f1
FROM (SELECT {g}, CAST(sum(CAST(p >= {t} AND y = 1 AS BIGINT)) AS BIGINT) AS tp,
             CAST(sum(CAST(p >= {t} AND y <> 1 AS BIGINT)) AS BIGINT) AS fp,
             CAST(sum(CAST(p < {t} AND y = 1 AS BIGINT)) AS BIGINT) AS fn,
             CAST(sum(CAST(p < {t} AND y <> 1 AS BIGINT)) AS BIGINT) AS tn
      FROM {src} GROUP BY {g})"""


def _sql_counts(src: str, g: str) -> str:
    return (f"SELECT {g}, p, CAST(sum(CAST(y = 1 AS BIGINT)) AS BIGINT) AS npos, "
            f"CAST(sum(CAST(y <> 1 AS BIGINT)) AS BIGINT) AS nneg FROM {src} GROUP BY {g}, p")


def _sql_auc(src: str, g: str) -> str:
    return f"""SELECT {g}, CASE WHEN sum(npos) = 0 OR sum(nneg) = 0 THEN NULL
       ELSE sum(CAST(npos AS DOUBLE) * (CAST(below AS DOUBLE) + 0.5::DOUBLE * CAST(nneg AS DOUBLE)))
            / CAST(sum(npos) * sum(nneg) AS DOUBLE) END AS auc
FROM (SELECT *, coalesce(sum(nneg) OVER (PARTITION BY {g} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM ({_sql_counts(src, g)})) GROUP BY {g}"""


def _sql_ap(src: str, g: str) -> str:
    return f"""SELECT {g}, sum(CAST(npos AS DOUBLE) / CAST(tot_pos AS DOUBLE) * (CAST(ge_pos AS DOUBLE) / CAST(ge_pos + ge_neg AS DOUBLE))) AS ap
FROM (SELECT *, sum(npos) OVER (PARTITION BY {g} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ge_pos,
             sum(nneg) OVER (PARTITION BY {g} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ge_neg,
             sum(npos) OVER (PARTITION BY {g}) AS tot_pos
      FROM ({_sql_counts(src, g)})) GROUP BY {g}"""


def _sql_prob(src: str, g: str) -> str:
    q = f"least(greatest(p, {mt.LOG_EPS}::DOUBLE), 1.0::DOUBLE - {mt.LOG_EPS}::DOUBLE)"
    return f"""SELECT {g}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg(pow(p - y, 2)) AS brier,
       avg(CAST(y AS DOUBLE)) * (1 - avg(CAST(y AS DOUBLE))) AS brier_prior,
       -avg(y * ln({q}) + (1 - y) * ln(1 - {q})) AS log_loss, min(p) AS p_min, max(p) AS p_max, avg(p) AS p_mean
FROM {src} GROUP BY {g}"""


BIN_PROBS = [i * (1.0 / 5) for i in range(5)] + [1.0]
_INNER = "[" + ", ".join(repr(q) for q in BIN_PROBS[1:-1]) + "]"


def _sql_bins(src: str, g: str) -> str:
    return f"""SELECT s.*, least(greatest(len(list_filter(qb.edges, lambda e: e <= s.p)), 0), 4) AS bin
FROM {src} s JOIN (SELECT {g}, quantile_cont(p, {_INNER}) AS edges FROM {src} GROUP BY {g}) qb USING ({g})"""


def _sql_ece(src: str, g: str) -> str:
    return f"""SELECT {g}, sum(abs(mp - my) * nb) / sum(nb) AS ece
FROM (SELECT {g}, bin, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS my, count(*) AS nb FROM ({_sql_bins(src, g)}) GROUP BY {g}, bin)
GROUP BY {g}"""


@register("confusion_metrics", _with(sv.scored()) + _sql_confusion("scored", "split"))
def confusion_metrics(spark, sf_dir):
    return mt.confusion(ad.scored(spark, sf_dir), ["split"], OPT_THRESHOLD)


@register("roc_auc", _with(sv.scored()) + _sql_auc("scored", "split"))
def roc_auc(spark, sf_dir):
    return mt.roc_auc(ad.scored(spark, sf_dir), ["split"])


@register("avg_precision", _with(sv.scored()) + _sql_ap("scored", "split"))
def avg_precision(spark, sf_dir):
    return mt.average_precision(ad.scored(spark, sf_dir), ["split"])


@register("brier_logloss", _with(sv.scored()) + _sql_prob("scored", "split"))
def brier_logloss(spark, sf_dir):
    return mt.prob_metrics(ad.scored(spark, sf_dir), ["split"])


@register("class_balance", _with(sv.vectors()) + """
SELECT split, count(*) AS n, CAST(sum(CAST(y = 1 AS BIGINT)) AS BIGINT) AS n_pos,
       CAST(sum(CAST(y <> 1 AS BIGINT)) AS BIGINT) AS n_neg, avg(CAST(y AS DOUBLE)) AS pos_rate
FROM vectors GROUP BY split""")
def class_balance(spark, sf_dir):
    return mt.class_balance(ad.vectors(spark, sf_dir), ["split"])


@register("ece", _with(sv.oof_scores()) + _sql_ece("oof", "repeat"))
def ece_query(spark, sf_dir):
    return mt.ece(ad.oof_scores(spark, sf_dir), ["repeat"])


@register("reliability", _with(sv.oof_scores()) + f"""
, pooled AS (SELECT record_id, 0 AS one, any_value(y) AS y, avg(p) AS p FROM oof GROUP BY record_id),
pb AS ({_sql_bins('pooled', 'one')})
SELECT CAST(bin + 1 AS INTEGER) AS bin, printf('%.3f-%.3f', round_even(min(p), 3), round_even(max(p), 3)) AS p_range,
       count(*) AS n, avg(p) AS mean_predicted, avg(CAST(y AS DOUBLE)) AS observed_rate
FROM pb GROUP BY bin""")
def reliability(spark, sf_dir):
    o = ad.oof_scores(spark, sf_dir)
    pooled = o.groupBy("record_id").agg(F.first("y").alias("y"), F.avg("p").alias("p"))
    return mt.reliability(pooled, [])


# --------------------------------------------------------------------------- A2 M8 A11-A14 J11 P19 P20 P22
_GRID91 = "[" + ", ".join(repr(t) for t in th.threshold_grid()) + "]::DOUBLE[]"
_FK = "encoder, family, seed, grid_pos, fold"


def _sql_selection() -> str:
    return _with(sv.sweep_scores()) + f"""
, thr AS (SELECT unnest({_GRID91}) AS threshold, generate_subscripts({_GRID91}, 1) - 1 AS k),
sb AS (SELECT {_FK}, y, len(list_filter({_GRID91}, lambda t: t <= p)) AS j FROM sweep),
scnt AS (SELECT {_FK}, j, sum(CAST(y = 1 AS BIGINT)) AS pos, sum(CAST(y <> 1 AS BIGINT)) AS neg FROM sb GROUP BY ALL),
stot AS (SELECT {_FK}, sum(pos) AS tot_pos FROM scnt GROUP BY ALL),
sfull AS (SELECT t.encoder, t.family, t.seed, t.grid_pos, t.fold, t.tot_pos, thr.k, thr.threshold,
                 coalesce(c.pos, 0) AS pos, coalesce(c.neg, 0) AS neg
          FROM stot t CROSS JOIN thr
          LEFT JOIN scnt c ON c.encoder = t.encoder AND c.family = t.family AND c.seed = t.seed
                          AND c.grid_pos = t.grid_pos AND c.fold = t.fold AND c.j = thr.k + 1),
ssum AS (SELECT *, sum(pos) OVER (PARTITION BY {_FK} ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS tp,
                   sum(neg) OVER (PARTITION BY {_FK} ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS fp FROM sfull),
sf1 AS (SELECT *, CASE WHEN 2*tp + fp + (tot_pos - tp) = 0 THEN 0.0
                  ELSE CAST(2*tp AS DOUBLE) / CAST(2*tp + fp + (tot_pos - tp) AS DOUBLE) END AS f1 FROM ssum),
fold_best AS (
  SELECT {_FK}, CASE WHEN f1 > 0 THEN threshold ELSE {th.DEFAULT_THRESHOLD}::DOUBLE END AS threshold, f1
  FROM (SELECT *, row_number() OVER (PARTITION BY {_FK} ORDER BY f1 DESC, k) AS r FROM sf1) WHERE r = 1),
smeans AS (SELECT encoder, family, seed, grid_pos, avg(f1) AS cv_f1, avg(threshold) AS mean_t
           FROM fold_best GROUP BY ALL HAVING count(*) = {sel.CV_FOLDS}),
best AS (
  SELECT b.encoder, b.family, b.seed, b.grid_pos, b.cv_f1, round_even(b.mean_t, 2) AS opt_threshold, g.params
  FROM (SELECT *, row_number() OVER (PARTITION BY encoder, family, seed
                                     ORDER BY round(cv_f1, {sel.COMPARE_DIGITS}) DESC, grid_pos) AS r FROM smeans) b
  JOIN grid g ON g.family = b.family AND g.grid_pos = b.grid_pos WHERE b.r = 1),
summ AS (SELECT encoder, family, avg(cv_f1) AS cv_f1_mean, stddev_samp(cv_f1) AS cv_f1_std,
                avg(opt_threshold) AS opt_threshold_mean, count(*) AS n_seeds FROM best GROUP BY ALL)
"""


def _selection(spark, sf_dir):
    from ..session import reuse
    fb = reuse(spark, ("fold_best", sf_dir), lambda: sel.fold_thresholds(ad.sweep_scores(spark, sf_dir)))
    best = sel.best_settings(sel.setting_means(fb), sel.grid_frame(spark, lg.LINEAR_GRIDS))
    return fb, best, sel.summary(best)


_ALL_GRIDS = {**sel.GRIDS, **lg.LINEAR_GRIDS}


def _sql_fitted_grid() -> str:
    return _with(sv.sweep_scores(), sv.grid(_ALL_GRIDS).replace("grid AS", "all_grid AS", 1)) + """
, fits AS (SELECT family, grid_pos, count(*) AS n_fits
           FROM (SELECT DISTINCT encoder, family, grid_pos, seed, fold FROM sweep) GROUP BY ALL),
fitted_grid AS (SELECT g.family, g.grid_pos, g.params, coalesce(f.n_fits, 0) AS n_fits
                FROM all_grid g LEFT JOIN fits f ON f.family = g.family AND f.grid_pos = g.grid_pos)
"""


def _fitted_grid(spark, sf_dir):
    """M8: all expanded grids, with the number of fits (encoders x seeds x folds) that
    each setting has in the sweep; a setting that no fold could fit has none, and the
    settings of the five iterative families are fitted by ``family_sweep`` instead."""
    fits = (ad.sweep_scores(spark, sf_dir).select("encoder", "family", "grid_pos", "seed", "fold").distinct()
              .groupBy("family", "grid_pos").agg(F.count(F.lit(1)).alias("n_fits")))
    return (sel.grid_frame(spark, _ALL_GRIDS).join(fits, ["family", "grid_pos"], "left")
               .withColumn("n_fits", F.coalesce("n_fits", F.lit(0).cast("long"))))


@register("grid_expand", _sql_fitted_grid() + "SELECT family, grid_pos, params, n_fits FROM fitted_grid")
def grid_expand(spark, sf_dir):
    return _fitted_grid(spark, sf_dir)


@register("params_roundtrip", _sql_fitted_grid() + """
SELECT family, grid_pos, CAST(json_extract_string(params, '$.C') AS DOUBLE) AS c,
       CAST(json_extract_string(params, '$.n_estimators') AS INTEGER) AS n_estimators,
       CAST(json_extract_string(params, '$.max_depth') AS INTEGER) AS max_depth,
       json_extract_string(params, '$.gamma') AS gamma, CAST(json_extract_string(params, '$.scale') AS DOUBLE) AS scale, n_fits
FROM fitted_grid""")
def params_roundtrip(spark, sf_dir):
    g = _fitted_grid(spark, sf_dir)
    return g.select("family", "grid_pos", ser.setting_field("params", "C", "double").alias("c"),
                    ser.setting_field("params", "n_estimators", "int").alias("n_estimators"),
                    ser.setting_field("params", "max_depth", "int").alias("max_depth"),
                    ser.setting_field("params", "gamma", "string").alias("gamma"),
                    ser.setting_field("params", "scale", "double").alias("scale"), "n_fits")


@register("best_threshold", _sql_selection() + f"SELECT {_FK}, threshold, f1 FROM fold_best")
def best_threshold_q(spark, sf_dir):
    return _selection(spark, sf_dir)[0]          # the shared per-fit thresholds


@register("best_setting", _sql_selection() + "SELECT * FROM best")
def best_setting(spark, sf_dir):
    return _selection(spark, sf_dir)[1]


@register("selection_summary", _sql_selection() + "SELECT * FROM summ")
def selection_summary(spark, sf_dir):
    return _selection(spark, sf_dir)[2]


@register("winner", _sql_selection() + f"""
, top AS (SELECT * FROM summ ORDER BY round(cv_f1_mean, {sel.COMPARE_DIGITS}) DESC, encoder, family LIMIT 1),
modal AS (SELECT encoder, family, params AS modal_params FROM (
  SELECT encoder, family, params, row_number() OVER (PARTITION BY encoder, family ORDER BY count(*) DESC, params) AS r
  FROM best GROUP BY encoder, family, params) WHERE r = 1)
SELECT top.*, modal.modal_params FROM top LEFT JOIN modal USING (encoder, family)""")
def winner_q(spark, sf_dir):
    _, best, summ = _selection(spark, sf_dir)
    return sel.winner(summ, best)


@register("winner_seeds", _sql_selection() + f"""
, top AS (SELECT encoder, family FROM summ ORDER BY round(cv_f1_mean, {sel.COMPARE_DIGITS}) DESC, encoder, family LIMIT 1)
SELECT b.* FROM best b JOIN top t ON b.encoder = t.encoder AND b.family = t.family""")
def winner_seeds(spark, sf_dir):
    _, best, summ = _selection(spark, sf_dir)
    top = sel.winner(summ, best).select("encoder", "family")
    return best.join(top, ["encoder", "family"], "left_semi")     # equality filter on the pair


@register("chart_series", _sql_selection() + f"""
SELECT encoder, family, (SELECT count(*) FROM summ o, summ me WHERE o.encoder = (SELECT min(encoder) FROM summ) AND me.encoder = o.encoder AND me.family = summ.family
         AND (round(o.cv_f1_mean, {sel.COMPARE_DIGITS}) > round(me.cv_f1_mean, {sel.COMPARE_DIGITS})
              OR round(o.cv_f1_mean, {sel.COMPARE_DIGITS}) = round(me.cv_f1_mean, {sel.COMPARE_DIGITS}) AND o.family <= me.family))::INTEGER AS order_pos,
       cv_f1_mean AS m, coalesce(cv_f1_std, 0.0) AS s, cv_f1_mean - coalesce(cv_f1_std, 0.0) AS m_minus_s,
       cv_f1_mean + coalesce(cv_f1_std, 0.0) AS m_plus_s
FROM summ WHERE starts_with(encoder, 'dom') OR starts_with(encoder, 'gen')""")
def chart_series(spark, sf_dir):
    summ = _selection(spark, sf_dir)[2]
    summ = summ.filter(F.col("encoder").startswith("dom") | F.col("encoder").startswith("gen"))
    return sel.chart_series(summ)


@register("holdout_winner", _sql_selection() + f"""
, top AS (SELECT * FROM summ ORDER BY round(cv_f1_mean, {sel.COMPARE_DIGITS}) DESC, encoder, family LIMIT 1),
modal AS (SELECT grid_pos, params FROM (
  SELECT b.grid_pos, b.params, row_number() OVER (ORDER BY count(*) DESC, b.params) AS r
  FROM best b JOIN top t ON b.encoder = t.encoder AND b.family = t.family GROUP BY b.grid_pos, b.params) WHERE r = 1),
hw_src AS (SELECT record_id, y, embedding FROM vectors),
{sv.unit_encodings('hw_src', 'hw_x')},
hw_train AS (SELECT x.encoder, x.y, x.x FROM hw_x x JOIN vectors v ON v.record_id = x.record_id AND v.split = 'train'),
{sv.linear_models('hw_train', 'encoder', 'hw_model')},
hw AS (
  SELECT v.y, {sv.linear_p('x.x', 'm')} AS p, round_even(t.opt_threshold_mean, 2) AS threshold
  FROM vectors v JOIN hw_x x ON x.record_id = v.record_id JOIN top t ON t.encoder = x.encoder
  JOIN modal d ON true JOIN hw_model m ON m.encoder = t.encoder AND m.family = t.family AND m.grid_pos = d.grid_pos
  WHERE v.split = 'test'),
hc AS (SELECT count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
              count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn FROM hw),
hr AS (SELECT y, count(*) FILTER (y = 1) OVER (ORDER BY p DESC) AS tps, count(*) OVER (ORDER BY p DESC) AS called,
              count(*) FILTER (y = 0) OVER (ORDER BY p GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
              count(*) FILTER (y = 0) OVER (ORDER BY p GROUPS BETWEEN CURRENT ROW AND CURRENT ROW) AS same FROM hw),
ha AS (SELECT CASE WHEN count(*) FILTER (y = 1) = 0 OR count(*) FILTER (y = 0) = 0 THEN NULL
              ELSE sum(below + 0.5 * same) FILTER (y = 1) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) END AS auc,
              avg(CAST(tps AS DOUBLE) / called) FILTER (y = 1) AS ap FROM hr)
SELECT t.encoder, t.family, d.params, round_even(t.opt_threshold_mean, 2) AS threshold, tp, fp, fn, tn,
       (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision",
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, auc, ap
FROM top t, modal d, hc, ha""")
def holdout_winner(spark, sf_dir):
    """M12: the winner's modal setting refitted on the whole train split, judged once on
    the hold-out at the mean of its seeds' thresholds."""
    from ..functions.vectors import with_one_row
    _, best, summ = _selection(spark, sf_dir)
    top = sel.winner(summ, best).withColumnRenamed("modal_params", "params")
    top = top.join(sel.grid_frame(spark, lg.LINEAR_GRIDS), ["family", "params"]) \
             .select("encoder", "family", "grid_pos", "params", F.bround("opt_threshold_mean", 2).alias("threshold"))
    v = ad.vectors(spark, sf_dir)
    s = lg.refit_chosen(v.filter(F.col("split") == "train"), v.filter(F.col("split") == "test"), top.drop("params"))
    s = s.withColumn("p_above", (F.col("p") >= F.col("threshold")).cast("double"))
    got = with_one_row(mt.confusion(s, [], 1.0, p="p_above"), mt.rank_metrics(s, []))
    return with_one_row(got, top.drop("grid_pos"))


# --------------------------------------------------------------------------- A21-A23 K1 U2
from ..functions import numeric as nu  # noqa: E402
from ..operators import calibrate as cb  # noqa: E402
from ..operators import passfits as pf  # noqa: E402

_SENS = "[" + ", ".join(repr(t) for t in th.SENSITIVITY) + "]::DOUBLE[]"
_SEEDT = sorted(set(th.CV_SEED_THRESHOLDS.values()))
_SEEDT_SQL = "[" + ", ".join(repr(t) for t in _SEEDT) + "]::DOUBLE[]"


@register("threshold_pivot", _with(sv.screen_set()) + "SELECT record_id, grp, name, p, "
          + ", ".join(f"CAST(p >= {t!r}::DOUBLE AS INTEGER) AS t_{t:.2f}".replace("t_0.", "t_0_") for t in th.SENSITIVITY)
          + " FROM screen")
def threshold_pivot(spark, sf_dir):
    return th.calls_wide(ad.screen_set(spark, sf_dir), ["record_id", "grp", "name", "p"])


@register("threshold_flips", _with(sv.screen_set()) + f"""
SELECT threshold, CAST(sum(CAST(p >= threshold AS BIGINT)) AS BIGINT) AS n_calls,
       CAST(sum(CAST((p >= threshold) <> (p >= {th.BASE_THRESHOLD}::DOUBLE) AS BIGINT)) AS BIGINT) AS n_flips
FROM screen, (SELECT unnest({_SENS}) AS threshold) t WHERE grp = 'screen' GROUP BY threshold""")
def threshold_flips(spark, sf_dir):
    return th.flips(ad.screen_set(spark, sf_dir).filter(F.col("grp") == "screen"))


@register("flipped_records", _with(sv.screen_set()) + f"""
SELECT threshold, record_id FROM screen, (SELECT unnest({_SEEDT_SQL}) AS threshold) t
WHERE grp = 'screen' AND (p >= threshold) <> (p >= {th.BASE_THRESHOLD}::DOUBLE)""")
def flipped_records(spark, sf_dir):
    s = ad.screen_set(spark, sf_dir).filter(F.col("grp") == "screen")
    return th.flipped_records(s, "record_id", thresholds=_SEEDT)


_BAND = th.stability_band()


@register("stable_calls", _with(sv.screen_set()) + f"""
SELECT record_id, grp, p FROM screen WHERE p >= {_BAND[1]!r}::DOUBLE OR p < {_BAND[0]!r}::DOUBLE""")
def stable_calls(spark, sf_dir):
    return th.stable_calls(ad.screen_set(spark, sf_dir)).select("record_id", "grp", "p")


# --------------------------------------------------------------------------- A18 A19 A25 W1
def _sql_boot_summary() -> str:
    return f"""bsum AS (
  SELECT record_id, avg(p) AS p_boot_mean, stddev_pop(p) AS p_boot_sd, quantile_cont(p, 0.025) AS p_boot_lo,
         quantile_cont(p, 0.975) AS p_boot_hi, avg(CAST(p >= {_T} AS DOUBLE)) AS freq_call
  FROM boot GROUP BY record_id)"""


@register("boot_summary", _with(sv.boot_scores(), _sql_boot_summary()) + f"""
SELECT s.record_id, s.grp, s.name, s.p AS p_point, CAST(s.p >= {_T} AS INTEGER) AS pred_point,
       b.p_boot_mean, b.p_boot_sd, b.p_boot_lo, b.p_boot_hi, b.freq_call
FROM screen s JOIN bsum b ON s.record_id = b.record_id""")
def boot_summary(spark, sf_dir):
    s = ad.screen_set(spark, sf_dir)
    b = rs.boot_summary(ad.boot_scores(spark, sf_dir), OPT_THRESHOLD)
    return s.select("record_id", "grp", "name", F.col("p").alias("p_point"),
                    decide("p", OPT_THRESHOLD).alias("pred_point")).join(b, "record_id")


@register("boot_ranks", _with(sv.boot_scores()) + """
, rk AS (SELECT replicate, record_id, row_number() OVER (PARTITION BY replicate ORDER BY p DESC, record_id) AS rank
         FROM boot WHERE grp = 'screen'),
rsum AS (SELECT record_id, avg(rank) AS rank_mean, round_even(quantile_cont(rank, 0.025), 0) AS rank_lo,
                round_even(quantile_cont(rank, 0.975), 0) AS rank_hi FROM rk GROUP BY record_id)
SELECT s.record_id, s.grp, r.rank_mean, r.rank_lo, r.rank_hi FROM screen s LEFT JOIN rsum r ON s.record_id = r.record_id""")
def boot_ranks(spark, sf_dir):
    b = ad.boot_scores(spark, sf_dir).filter(F.col("grp") == "screen")
    r = rs.rank_summary(rs.replicate_ranks(b))
    return ad.screen_set(spark, sf_dir).select("record_id", "grp").join(r, "record_id", "left")


@register("boxplot_stats", _with(sv.boot_scores()) + """
SELECT s.record_id, s.p, quantile_cont(b.p, 0.025) AS q025, quantile_cont(b.p, 0.25) AS q25,
       quantile_cont(b.p, 0.5) AS q50, quantile_cont(b.p, 0.75) AS q75, quantile_cont(b.p, 0.975) AS q975
FROM screen s JOIN boot b ON s.record_id = b.record_id GROUP BY s.record_id, s.p""")
def boxplot_stats(spark, sf_dir):
    s = ad.screen_set(spark, sf_dir).select("record_id", "p")
    return s.join(rs.box_stats(ad.boot_scores(spark, sf_dir)), "record_id")


# --------------------------------------------------------------------------- A15 A16 K2
@register("oof_summary", _with(sv.oof_scores()) + """
SELECT record_id, any_value(y) AS y, avg(p) AS p_oof_mean, stddev_pop(p) AS p_oof_sd FROM oof GROUP BY record_id""")
def oof_summary(spark, sf_dir):
    return cb.oof_summary(ad.oof_scores(spark, sf_dir))


def _sql_calibration() -> str:
    """cal: Newton's steps from (0, 0) for all repeats at once, as a recursive query."""
    c = f"{cb.CAL_C}::DOUBLE"
    return f"""cx AS MATERIALIZED (
  SELECT repeat, CAST(y AS DOUBLE) AS y, ln(q / (1.0::DOUBLE - q)) AS x
  FROM (SELECT repeat, y, least(greatest(p, {nu.LOG_EPS}::DOUBLE), 1.0::DOUBLE - {nu.LOG_EPS}::DOUBLE) AS q FROM oof)),
steps AS (
  SELECT DISTINCT repeat, 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS moved FROM cx
  UNION ALL
  SELECT repeat, i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab),
         greatest(abs((hbb * ga - hab * gb) / (haa * hbb - hab * hab)), abs((haa * gb - hab * ga) / (haa * hbb - hab * hab)))
  FROM (SELECT repeat, i, a, b, {c} * sum((q - y) * x) + a AS ga, {c} * sum(q - y) AS gb,
               {c} * sum(q * (1 - q) * x * x) + 1 AS haa, {c} * sum(q * (1 - q) * x) AS hab, {c} * sum(q * (1 - q)) AS hbb
        FROM (SELECT s.repeat, s.i, s.a, s.b, cx.x, cx.y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(s.a * cx.x + s.b))) AS q
              FROM steps s JOIN cx ON s.repeat = cx.repeat WHERE s.i < 20) GROUP BY repeat, i, a, b)),
cal AS (SELECT repeat, a AS cal_slope, b AS cal_intercept, moved < 1e-7 AS converged FROM steps WHERE i = 20)"""


@register("calibration_slope", _with(sv.oof_scores(), _sql_calibration()).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT * FROM cal")
def calibration_slope(spark, sf_dir):
    return cb.calibration_fit(ad.oof_scores(spark, sf_dir))


@register("metric_unpivot", _with(sv.oof_scores(), _sql_calibration()).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, m_auc AS ({_sql_auc('oof', 'repeat')}),
m_ap AS ({_sql_ap('oof', 'repeat')}),
m_pr AS ({_sql_prob('oof', 'repeat')}),
m_ece AS ({_sql_ece('oof', 'repeat')}),
m_f1 AS (SELECT repeat, f1 AS f1_t FROM ({_sql_confusion('oof', 'repeat')})),
m_f5 AS (SELECT repeat, f1 AS f1_05 FROM ({_sql_confusion('oof', 'repeat', '0.5::DOUBLE')})),
per AS (SELECT m_auc.repeat, auc, ap, brier, log_loss, ece, cal_slope, cal_intercept, p_min, p_max, p_mean, f1_t, f1_05
        FROM m_auc JOIN m_ap USING (repeat) JOIN m_pr USING (repeat) JOIN m_ece USING (repeat)
        JOIN m_f1 USING (repeat) JOIN m_f5 USING (repeat) JOIN cal USING (repeat)),
lg AS (UNPIVOT per ON auc, ap, brier, log_loss, ece, cal_slope, cal_intercept, p_min, p_max, p_mean, f1_t, f1_05 INTO NAME metric VALUE value),
prior AS (SELECT avg(CAST(y AS DOUBLE)) * (1 - avg(CAST(y AS DOUBLE))) AS brier_class_prior FROM vectors)
SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, any_value(prior.brier_class_prior) AS brier_class_prior
FROM lg, prior GROUP BY metric""")
def metric_unpivot(spark, sf_dir):
    o = ad.oof_scores(spark, sf_dir)
    return cb.metric_table(cb.repeat_metrics(o, OPT_THRESHOLD), ad.vectors(spark, sf_dir))


# --------------------------------------------------------------------------- A20 A24 J9 J10 P15-P18 P23 W4 A27
@register("deviation_check", _with(sv.boot_scores(), _sql_boot_summary()) + """
, pub AS (SELECT s.record_id, round_even(b.p_boot_mean, 3) AS published FROM screen s JOIN bsum b ON s.record_id = b.record_id WHERE s.grp = 'screen')
SELECT max(abs(s.p - pub.published)) AS max_dev, count(pub.published) AS n_published
FROM screen s LEFT JOIN pub ON s.record_id = pub.record_id""")
def deviation_check(spark, sf_dir):
    """Largest distance of a score from the value reported for its record: the mean over
    its bootstrap refits, to 3 decimals, of the records in the ranked report."""
    s = ad.screen_set(spark, sf_dir)
    means = rs.boot_summary(ad.boot_scores(spark, sf_dir), OPT_THRESHOLD).select("record_id", F.bround("p_boot_mean", 3).alias("published"))
    pub = means.join(s.filter(F.col("grp") == "screen").select("record_id"), "record_id", "left_semi")
    return (s.select("record_id", "p").join(pub, "record_id", "left")
             .agg(F.max(F.abs(F.col("p") - F.col("published"))).alias("max_dev"),
                  F.count("published").alias("n_published")))


def _described(df, spark, sf_dir):
    """Report rows with the descriptors of their record, null where it has none."""
    d = ad.texts(spark, sf_dir).select("record_id", "lang", "source", "n_chars")
    return df.join(d, "record_id", "left")


_DESCRIBED = "d.lang, d.source, CAST(d.n_chars AS VARCHAR) AS n_chars"


@register("agreement_report", _with(sv.boot_scores(), _sql_boot_summary()) + f"""
SELECT s.record_id, s.name, {_DESCRIBED}, CASE WHEN s.y = 1 THEN 'induction' ELSE 'inhibition' END AS reported_effect,
       s.y AS ref_label, s.p AS p_class1, CAST(s.p >= {_T} AS INTEGER) AS prediction,
       CASE WHEN CAST(s.p >= {_T} AS INTEGER) = s.y THEN 'yes' ELSE 'NO' END AS agreement, b.freq_call AS freq_boot
FROM screen s JOIN bsum b ON s.record_id = b.record_id LEFT JOIN documents d ON d.doc_id = s.record_id WHERE s.grp = 'validation'""")
def agreement_report(spark, sf_dir):
    s = ad.screen_set(spark, sf_dir).filter(F.col("grp") == "validation")
    b = rs.boot_summary(ad.boot_scores(spark, sf_dir), OPT_THRESHOLD).select("record_id", "freq_call")
    call = decide("p", OPT_THRESHOLD)
    return _described(s.join(b, "record_id"), spark, sf_dir).select(
        "record_id", "name", "lang", "source", "n_chars", class_name("y").alias("reported_effect"),
        F.col("y").alias("ref_label"), F.col("p").alias("p_class1"), call.alias("prediction"),
        F.when(call == F.col("y"), F.lit("yes")).otherwise(F.lit("NO")).alias("agreement"),
        F.col("freq_call").alias("freq_boot"))


@register("agreement_rate", _with(sv.screen_set()) + f"""
SELECT CAST(sum(CAST(CAST(p >= {_T} AS INTEGER) = y AS BIGINT)) AS BIGINT) AS n_agree, count(*) AS n,
       avg(CAST(CAST(p >= {_T} AS INTEGER) = y AS DOUBLE)) AS rate
FROM screen WHERE grp = 'validation'""")
def agreement_rate(spark, sf_dir):
    s = ad.screen_set(spark, sf_dir).filter(F.col("grp") == "validation")
    agree = decide("p", OPT_THRESHOLD) == F.col("y")
    return s.agg(F.count_if(agree).alias("n_agree"), F.count(F.lit(1)).alias("n"),
                 F.avg(agree.cast("double")).alias("rate"))


@register("ranked_report", _with(sv.boot_scores(), _sql_boot_summary()) + f"""
SELECT s.record_id, s.name, {_DESCRIBED}, s.p AS p_class1, CAST(s.p >= {_T} AS INTEGER) AS prediction,
       printf('%.3f-%.3f', round_even(b.p_boot_lo, 3), round_even(b.p_boot_hi, 3)) AS p_boot_95ci,
       b.freq_call AS freq_boot
FROM screen s JOIN bsum b ON s.record_id = b.record_id LEFT JOIN documents d ON d.doc_id = s.record_id WHERE s.grp = 'screen'""")
def ranked_report(spark, sf_dir):
    s = ad.screen_set(spark, sf_dir).filter(F.col("grp") == "screen")
    b = rs.boot_summary(ad.boot_scores(spark, sf_dir), OPT_THRESHOLD)
    return (_described(s.join(b, "record_id"), spark, sf_dir)
             .select("record_id", "name", "lang", "source", "n_chars", F.col("p").alias("p_class1"),
                     decide("p", OPT_THRESHOLD).alias("prediction"),
                     nu.interval_text("p_boot_lo", "p_boot_hi").alias("p_boot_95ci"),
                     F.col("freq_call").alias("freq_boot"))
             .orderBy(F.desc("p_class1"), "record_id"))


@register("error_bars", _with(sv.boot_scores(), _sql_boot_summary()) + """
SELECT s.record_id, s.p - b.p_boot_lo AS err_lo, b.p_boot_hi - s.p AS err_hi
FROM screen s JOIN bsum b ON s.record_id = b.record_id""")
def error_bars(spark, sf_dir):
    s = ad.screen_set(spark, sf_dir)
    b = rs.boot_summary(ad.boot_scores(spark, sf_dir), OPT_THRESHOLD)
    return s.join(b, "record_id").select("record_id", (F.col("p") - F.col("p_boot_lo")).alias("err_lo"),
                                         (F.col("p_boot_hi") - F.col("p")).alias("err_hi"))


@register("display_order", _with(sv.screen_set()) + """
SELECT record_id, grp, p, row_number() OVER (ORDER BY grp <> 'validation', p DESC, record_id) AS num FROM screen""")
def display_order(spark, sf_dir):
    from ..operators.prefix import prefix_sums
    s = ad.screen_set(spark, sf_dir).select("record_id", "grp", "p").withColumn("_one", F.lit(1).cast("long"))
    key = F.when(F.col("grp") == "validation", F.lit(0.0)).otherwise(F.lit(2.0)) - F.col("p")   # validation first, p desc
    r = prefix_sums(s, [], key, ["_one"], tie_cols=["record_id"], out_prefix="_before")
    return r.select("record_id", "grp", "p", (F.col("_before_one") + 1).cast("long").alias("num"))


@register("logit_scores", _with(sv.screen_set()) + f"""
SELECT record_id, ln(q / (1.0::DOUBLE - q)) AS logit_p
FROM (SELECT record_id, least(greatest(p, {nu.LOG_EPS}::DOUBLE), 1.0::DOUBLE - {nu.LOG_EPS}::DOUBLE) AS q FROM screen)""")
def logit_scores(spark, sf_dir):
    return ad.screen_set(spark, sf_dir).select("record_id", nu.logit("p").alias("logit_p"))


@register("round_scores", _with(sv.screen_set()) + """
SELECT record_id, round_even(p, 3) AS p3, round_even(p, 2) AS p2 FROM screen""")
def round_scores(spark, sf_dir):
    return ad.screen_set(spark, sf_dir).select("record_id", nu.round_half_even("p", 3).alias("p3"),
                                               nu.round_half_even("p", 2).alias("p2"))


# --------------------------------------------------------------------------- V9 V10 J5 W5 A26 U1
MAP_SCALE = 100.0        # map coordinates: 100 x (cosine to class-1 centroid, cosine to class-0 centroid)


def _map_points(df):
    return df.select("record_id", (F.lit(MAP_SCALE) * F.col("cos1")).alias("x"),
                     (F.lit(MAP_SCALE) * F.col("cos0")).alias("y"))


@register("radius_neighbors", _with(sv.screen_set()) + f"""
, pts AS (SELECT record_id, {MAP_SCALE}::DOUBLE * cos1 AS x, {MAP_SCALE}::DOUBLE * cos0 AS y FROM screen),
pr AS (SELECT a.record_id AS i, b.record_id AS j FROM pts a JOIN pts b
       ON a.record_id <> b.record_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < {nb.RADIUS})
SELECT p.record_id, count(pr.j) AS n_near, CAST(coalesce(sum(CAST(pr.j < pr.i AS BIGINT)), 0) AS BIGINT) AS n_near_before
FROM pts p LEFT JOIN pr ON p.record_id = pr.i GROUP BY p.record_id""")
def radius_neighbors(spark, sf_dir):
    return nb.crowding(_map_points(ad.screen_set(spark, sf_dir)))


_SQL_RANGE = _with(sv.scored()) + f"""
SELECT min(c) AS cos_min, max(c) AS cos_max FROM (
  SELECT {sv.cosine('q.embedding', 'r.embedding')} AS c FROM scored q JOIN scored r ON q.split = 'test' AND r.split = 'train')"""


@register("similarity_range", _SQL_RANGE)
def similarity_range(spark, sf_dir):
    s = ad.scored(spark, sf_dir)
    return nb.similarity_range(s.filter(F.col("split") == "test").select("record_id", "embedding"),
                               s.filter(F.col("split") == "train").select("record_id", "embedding"))


@register("similarity_range_pruned", _SQL_RANGE)
def similarity_range_pruned(spark, sf_dir):
    """The same range by two pruned searches, held to the best pair of all queries."""
    s = ad.scored(spark, sf_dir)
    return nb.similarity_range(s.filter(F.col("split") == "test").select("record_id", "embedding"),
                               s.filter(F.col("split") == "train").select("record_id", "embedding"), prune_from=0)


@register("class_map", _with(sv.scored()) + f"""
SELECT record_id, {MAP_SCALE}::DOUBLE * cos1 AS x, {MAP_SCALE}::DOUBLE * cos0 AS y FROM scored WHERE split = 'train' AND y = 0""")
def class_map(spark, sf_dir):
    s = ad.scored(spark, sf_dir).filter((F.col("split") == "train") & (F.col("y") == 0))
    return _map_points(s)


@register("axis_bounds", _with(sv.screen_set()) + f"""
, pts AS (SELECT 'train' AS tag, {MAP_SCALE}::DOUBLE * cos1 AS x, {MAP_SCALE}::DOUBLE * cos0 AS y FROM scored WHERE split = 'train'
          UNION ALL SELECT 'screen' AS tag, {MAP_SCALE}::DOUBLE * cos1, {MAP_SCALE}::DOUBLE * cos0 FROM screen)
SELECT tag, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM pts GROUP BY tag""")
def axis_bounds(spark, sf_dir):
    tr = _map_points(ad.scored(spark, sf_dir).filter(F.col("split") == "train")).withColumn("tag", F.lit("train"))
    sc = _map_points(ad.screen_set(spark, sf_dir)).withColumn("tag", F.lit("screen"))
    u = tr.unionByName(sc)
    return u.groupBy("tag").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                                F.min("y").alias("y_min"), F.max("y").alias("y_max"))


# --------------------------------------------------------------------------- models (rows-only + unit tests)
from ..operators import features as fe  # noqa: E402
from ..operators import models as md  # noqa: E402


def _train_test(spark, sf_dir):
    v = ad.vectors(spark, sf_dir)
    return v.filter(F.col("split") == "train"), v.filter(F.col("split") == "test")


@register("score_new")
def score_new(spark, sf_dir):
    """Entry point B: fit standardise -> PCA95 -> LR(C=0.001) on the train split,
    score the hold-out records, call at 0.39 and rank."""
    tr, te = _train_test(spark, sf_dir)
    model = md.fit_pipeline(tr)
    s = md.positive_score(model, te.select("record_id", "embedding", "y"))
    s = s.withColumn("call", decide("p", OPT_THRESHOLD))
    return md.rank_desc(s)


def _scaled_train(spark, sf_dir):
    tr, te = _train_test(spark, sf_dir)
    sc = fe.PopulationStandardScaler(inputCol="features", outputCol="z").fit(md.as_features(tr))
    return sc, tr, te


@register("pca_curve")
def pca_curve(spark, sf_dir):
    sc, tr, _ = _scaled_train(spark, sf_dir)
    z = sc.transform(md.as_features(tr))
    full = fe.PCAByVariance(inputCol="z", outputCol="pc", varianceRatio=1.0).fit(z)
    k95 = fe.k_for_variance(full.full_ratios)
    return fe.variance_curve(full.full_ratios, spark).withColumn("k95", F.lit(k95))


@register("pca_map")
def pca_map(spark, sf_dir):
    from pyspark.ml.feature import PCA
    sc, tr, te = _scaled_train(spark, sf_dir)
    ztr = sc.transform(md.as_features(tr))
    pca = PCA(k=2, inputCol="z", outputCol="pc").fit(ztr)
    both = tr.withColumn("tag", F.lit("train")).unionByName(te.withColumn("tag", F.lit("new")))
    out = pca.transform(sc.transform(md.as_features(both)))
    return out.select("record_id", "tag", "y", vector_to_array("pc")[0].alias("pc1"),
                      vector_to_array("pc")[1].alias("pc2"))


def _fit_family(spark, sf_dir, family, params):
    tr, te = _train_test(spark, sf_dir)
    model = md.fit_pipeline(tr, family, params)
    return md.positive_score(model, te.select("record_id", "embedding", "y")), model, tr


@register("fit_lr_l1")
def fit_lr_l1(spark, sf_dir):
    return _fit_family(spark, sf_dir, "Logistic Regression", {"C": 1, "penalty": "l1"})[0]


@register("fit_rf")
def fit_rf(spark, sf_dir):
    return _fit_family(spark, sf_dir, "Random Forest",
                       {"n_estimators": 50, "max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 2})[0]


@register("fit_gbt")
def fit_gbt(spark, sf_dir):
    return _fit_family(spark, sf_dir, "XGBoost", {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.1,
                                                  "subsample": 0.8, "colsample_bytree": 0.8})[0]


@register("fit_svm_linear")
def fit_svm_linear(spark, sf_dir):
    """Linear SVM margins, Platt-scaled on margins of inner folds."""
    s, _, tr = _fit_family(spark, sf_dir, "SVM-Linear", {"C": 1})
    cal = md.platt(md.inner_margins(tr, lambda part: md.fit_pipeline(part, "SVM-Linear", {"C": 1}), md.positive_score))
    return s.withColumn("margin", F.col("p")).withColumn("p", cal(F.col("margin")))


@register("fit_svm_rff")
def fit_svm_rff(spark, sf_dir):
    """RBF SVM by random Fourier features on the PCA output (gamma='scale'), then
    a linear SVM and Platt scaling on margins of inner folds."""
    tr, te = _train_test(spark, sf_dir)
    margins = md.inner_margins(tr, md.fit_rff_svm, lambda model, rows: model(rows))
    cal = md.platt(margins)
    return md.fit_rff_svm(tr)(te).withColumn("margin", F.col("p")).withColumn("p", cal(F.col("margin")))


@register("holdout_eval")
def holdout_eval(spark, sf_dir):
    """Refit the selected setting on the train split, evaluate once on the hold-out."""
    tr, te = _train_test(spark, sf_dir)
    from ..functions.vectors import with_one_row
    s = md.positive_score(md.fit_pipeline(tr), te.select("record_id", "embedding", "y"))
    # both metric tables have one row: attach AUC / AP as a scalar record
    return with_one_row(mt.confusion(s, [], OPT_THRESHOLD), mt.rank_metrics(s, []))


# up to this many training rows a replicate's own rows are one small group, which is faster than passes
BOOT_COPY_ROWS = 2_000


@register("bootstrap_fit")
def bootstrap_fit(spark, sf_dir):
    """Bootstrap of the whole fit: one small pipeline per replicate (draw counts as
    weights), hold-out records scored by a join, summarised per record."""
    tr, te = _train_test(spark, sf_dir)
    counts = ad.boot_counts(spark, sf_dir)
    if tr.count() <= BOOT_COPY_ROWS:
        rows = counts.join(tr.select("record_id", "embedding", "y"), "record_id")
        reps = md.fit_linear_many(rows, ["replicate"], weight="draws").select(F.col("replicate").alias("slot"), "u", "b")
    else:
        # a record's vector travels once, with the list of its draws
        lists = counts.groupBy("record_id").agg(F.collect_list(F.struct("replicate", "draws")).alias("_c"))
        rows = tr.select("record_id", "embedding", "y").join(lists, "record_id").select("embedding", "y", F.col("_c.replicate").alias("slots"), F.col("_c.draws").alias("ws"))
        reps = pf.fit_listed(rows, rs.N_BOOT, weights="ws").select("slot", "u", "b")
    # every hold-out record is scored by every replicate (N_BOOT x dim numbers)
    te_rep = te.select("record_id", "embedding", F.sequence(F.lit(0), F.lit(rs.N_BOOT - 1)).alias("slots"))
    scored = md.score_listed(reps, te_rep, rs.N_BOOT)
    return rs.boot_summary(scored.select(F.col("slot").alias("replicate"), "record_id", "p"), OPT_THRESHOLD)


@register("oof_fit")
def oof_fit(spark, sf_dir):
    """Repeated stratified 5-fold (10 repeats): one small pipeline per (repeat,
    fold) fitted on the other folds, out-of-fold scores summarised per record."""
    rows = sp.fold_lists(ad.vectors(spark, sf_dir).select("record_id", "embedding", "y"), sp.repeated_kfold, "repeat")
    n_models = sp.OOF_REPEATS * sp.OOF_FOLDS
    model = lambda f, fold: f["repeat"] * sp.OOF_FOLDS + fold
    models = pf.fit_listed(rows.withColumn("slots", sp.other_folds(sp.OOF_FOLDS, model)), n_models)
    own = rows.withColumn("slots", F.transform("folds", lambda f: model(f, f["fold"]))).drop("folds")
    oof = md.score_listed(models, own, n_models).withColumn("repeat", F.floor(F.col("slot") / sp.OOF_FOLDS).cast("int"))
    return cb.oof_summary(oof.select("repeat", "record_id", "y", "p"))


# one setting a family keeps a run to 18 fits; sel.grid_rows() is the whole grid
FAMILY_SWEEP_SEEDS = (42,)


def _family_grid():
    """The first setting of each sub-grid of the five families."""
    seen, out = set(), []
    for family, pos, js in sel.grid_rows():
        kind = (family, json.loads(js).get("penalty"))
        if kind not in seen:
            seen.add(kind)
            out.append((family, pos, js))
    return out


@register("family_sweep")
def family_sweep(spark, sf_dir):
    """M8 / M11: the five families with Spark ML fits on a small grid (the first setting of
    each sub-grid, one seed, three folds): best setting, its mean F1 and threshold, and
    the number of fits made and refused, from the log that a restarted sweep goes on from."""
    import os
    import uuid

    from ..operators import sweep as sw
    from ..session import ensure_checkpoint_dir
    tr, _ = _train_test(spark, sf_dir)
    out = os.path.join(ensure_checkpoint_dir(spark), f"sweep-{uuid.uuid4().hex}")
    scores = sw.model_sweep(tr, _family_grid(), seeds=FAMILY_SWEEP_SEEDS, out_dir=out)
    best = sel.best_settings(sel.setting_means(sel.fold_thresholds(scores)), sel.grid_frame(spark))
    log = sw.sweep_status(spark, out).groupBy("encoder", "family").agg(
        F.sum(F.col("fitted").cast("int")).alias("n_fitted"), F.sum((~F.col("fitted")).cast("int")).alias("n_refused"))
    return log.join(best, ["encoder", "family"], "left")


@register("lr_sweep")
def lr_sweep(spark, sf_dir):
    """Model selection over the L2 logistic-regression C grid with real fits:
    5 seeds x 3 folds x 11 C values as one grouped fit, then the threshold search
    and selection chain over the validation scores."""
    tr, _ = _train_test(spark, sf_dir)
    rows = sp.fold_lists(tr, sp.stratified_kfold, "seed")
    # the L2 sub-grid is a fixed parameter list
    settings = [(pos, float(json.loads(js)["C"])) for fam, pos, js in sel.grid_rows()
                if fam == "Logistic Regression" and json.loads(js).get("penalty") == "l2"]
    seeds = F.array(*[F.lit(x) for x in sp.CV_SEEDS])
    model = lambda f, fold: ((F.array_position(seeds, f["seed"]) - 1) * sp.CV_FOLDS + fold).cast("int")
    # the rows of a (seed, fold) serve the whole C grid
    fits = pf.fit_listed(rows.withColumn("slots", sp.other_folds(sp.CV_FOLDS, model)), len(sp.CV_SEEDS) * sp.CV_FOLDS, c_grid=settings)
    models = fits.withColumn("seed", F.element_at(seeds, F.floor(F.col("slot") / sp.CV_FOLDS).cast("int") + 1)).withColumn("fold", F.col("slot") % sp.CV_FOLDS).drop("slot")
    a = rows.select("record_id", "embedding", "y", F.explode("folds").alias("_f")).select("record_id", "embedding", "y", "_f.*")
    val = md.score_linear(models, a, ["seed", "fold"], carry=["grid_pos"],
                          max_models=len(sp.CV_SEEDS) * sp.CV_FOLDS * len(settings))
    val = val.withColumn("encoder", F.lit("given")).withColumn("family", F.lit("Logistic Regression"))
    best = sel.best_settings(sel.setting_means(sel.fold_thresholds(val)), sel.grid_frame(spark))
    return best


# --------------------------------------------------------------------------- J3 J8 S7 V1c on documents
NB_TIE_DIGITS = 12


def _doc_neighbours(spark, sf_dir):
    """The neighbour table, computed once per application and shared by the
    neighbour reports (each text is tokenised once, not once per branch)."""
    from ..session import reuse
    return reuse(spark, ("doc_neighbours", sf_dir), lambda: _doc_neighbours_build(spark, sf_dir))


def _doc_neighbours_build(spark, sf_dir):
    from ..session import reuse
    r = ad.records(spark, sf_dir)
    # query and reference sides both read the document vectors: build them once
    vec = reuse(spark, ("doc_vectors", sf_dir),
                lambda: en.hashed_mean_pool(r.select("record_id", "text"), long_form=False))
    q_ids = r.filter(F.col("target").isNull()).select("record_id")
    ref_ids = r.filter(F.col("target").isNotNull()).select("record_id")
    q = vec.join(q_ids, "record_id", "left_semi")
    ref = vec.join(ref_ids, "record_id", "left_semi")
    # every record has a vector: the key tables give the block sizes without tokenising
    top = nb.knn_topk(q, ref, k=nb.TOP_K, tie_digits=NB_TIE_DIGITS,
                      n_queries=q_ids.count(), n_refs=ref_ids.count())
    disp = r.select(F.col("record_id").alias("ref_id"), F.col("target").alias("neighbour_label"),
                    tx.display_text("lang").alias("lang"), tx.display_text("source").alias("source"),
                    tx.display_text("text", tx.METABOLITE_WIDTH).alias("text_60"))
    return top.join(disp, "ref_id")


def _sql_doc_neighbours() -> str:
    return _with(sv.records()) + f"""
, toks AS (SELECT record_id, unnest({_tok('text')}) AS tok FROM records),
ntok AS (SELECT record_id, len({_tok('text')}) AS n_tokens FROM records),
per AS (SELECT record_id, CAST({sv.md5_long('tok')} % {en.HASH_DIM} AS INTEGER) AS dim, count(*) AS cnt FROM toks GROUP BY ALL),
lf AS (SELECT per.record_id, dim, cnt / n_tokens AS weight FROM per JOIN ntok USING (record_id)),
dense AS (SELECT r.record_id, list(coalesce(lf.weight, 0.0) ORDER BY d.dim) AS v
          FROM records r CROSS JOIN range({en.HASH_DIM}) d(dim)
          LEFT JOIN lf ON lf.record_id = r.record_id AND lf.dim = d.dim GROUP BY r.record_id),
qv AS (SELECT d.* FROM dense d JOIN records r USING (record_id) WHERE r.target IS NULL),
rv AS (SELECT d.* FROM dense d JOIN records r USING (record_id) WHERE r.target IS NOT NULL),
pairs AS (SELECT q.record_id AS query_id, rr.record_id AS ref_id,
                 {sv.cosine('q.v', 'rr.v')} AS cos FROM qv q, rv rr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, {NB_TIE_DIGITS}) DESC, ref_id) AS rank FROM pairs),
top AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, ref_id, round(cos, {NB_TIE_DIGITS}) AS cosine FROM ranked WHERE rank <= {nb.TOP_K}),
nbr AS (
  SELECT top.*, r.target AS neighbour_label, {_disp('r.lang')} AS lang, {_disp('r.source')} AS source,
         {_disp('r.text', tx.METABOLITE_WIDTH)} AS text_60
  FROM top JOIN records r ON r.record_id = top.ref_id)
"""


@register("neighbour_report", _sql_doc_neighbours() + "SELECT * FROM nbr")
def neighbour_report(spark, sf_dir):
    """Three nearest labelled documents of every unlabelled document (hashed
    mean-pooled token vectors, exact cosine) with their label and display text."""
    return _doc_neighbours(spark, sf_dir).select("query_id", "rank", "ref_id", "cosine", "neighbour_label",
                                                 "lang", "source", "text_60")


@register("neighbour_text", _sql_doc_neighbours() + """
, lines AS (
  SELECT query_id, rank, 0 AS ln, '  ' || rank || '. ' || ref_id || ' [' || coalesce(CAST(neighbour_label AS VARCHAR), 'ND')
         || '] cosine=' || printf('%.3f', round_even(cosine, 3)) AS line FROM nbr
  UNION ALL SELECT query_id, rank, 1, '     source: ' || source || '  |  lang: ' || lang FROM nbr
  UNION ALL SELECT query_id, rank, 2, '     text: ' || text_60 FROM nbr
  UNION ALL SELECT DISTINCT query_id, 0, 0, 'record ' || query_id FROM nbr)
SELECT query_id, string_agg(line, chr(10) ORDER BY rank, ln) AS report FROM lines GROUP BY query_id""")
def neighbour_text(spark, sf_dir):
    from ..sources.sinks import text_blocks
    nbr = _doc_neighbours(spark, sf_dir)
    lines = [
        (F.col("rank"), F.lit(0), F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "),
                                           F.col("ref_id").cast("string"), F.lit(" ["),
                                           F.coalesce(F.col("neighbour_label").cast("string"), F.lit("ND")),
                                           F.lit("] cosine="), F.format_string("%.3f", F.bround("cosine", 3)))),
        (F.col("rank"), F.lit(1), F.concat(F.lit("     source: "), F.col("source"), F.lit("  |  lang: "), F.col("lang"))),
        (F.col("rank"), F.lit(2), F.concat(F.lit("     text: "), F.col("text_60"))),
    ]
    header = F.concat(F.lit("record "), F.col("query_id").cast("string"))
    return text_blocks(nbr, "query_id", header, lines, out="report")


# --------------------------------------------------------------------------- J8 S7: screened records and their neighbours
_SQL_SHEET = _with(sv.screen_set()) + f"""
, knn AS ({_SQL_KNN}),
sheet AS (
  SELECT s.grp AS set_name, s.record_id, s.name, round_even(k.query_p, 3) AS p,
         CASE WHEN k.query_call = 1 THEN 'induction' ELSE 'inhibition' END AS call_name, k.rank,
         'rec' || CAST(k.ref_id AS VARCHAR) AS neighbour, k.neighbour_label, {_disp('d.lang')} AS lang,
         {_disp('d.source', tx.MICROORGANISM_WIDTH)} AS source_45, {_disp('d.text', tx.METABOLITE_WIDTH)} AS text_60,
         round_even(k.cosine, 3) AS cosine
  FROM knn k JOIN screen s ON s.record_id = k.query_id LEFT JOIN documents d ON d.doc_id = k.ref_id)
"""


def _neighbour_sheet(spark, sf_dir):
    """A row for each screened record and rank: its set, name, score and call, and the
    neighbour with label, cosine and display cells (``ND`` where it has no descriptors)."""
    s = ad.screen_set(spark, sf_dir).select(F.col("record_id").alias("query_id"), F.col("grp").alias("set_name"), "name")
    d = ad.texts(spark, sf_dir).select(F.col("record_id").alias("ref_id"), "lang", "source", "text")
    near = _knn(spark, sf_dir).join(s, "query_id").join(d, "ref_id", "left")
    return near.select("set_name", F.col("query_id").alias("record_id"), "name", F.bround("query_p", 3).alias("p"),
                       class_name("query_call").alias("call_name"), "rank",
                       F.concat(F.lit("rec"), F.col("ref_id").cast("string")).alias("neighbour"), "neighbour_label",
                       tx.display_text("lang").alias("lang"), tx.display_text("source", tx.MICROORGANISM_WIDTH).alias("source_45"),
                       tx.display_text("text", tx.METABOLITE_WIDTH).alias("text_60"), F.bround("cosine", 3).alias("cosine"))


@register("neighbour_sheet", _SQL_SHEET + "SELECT * FROM sheet")
def neighbour_sheet(spark, sf_dir):
    return _neighbour_sheet(spark, sf_dir)


@register("neighbour_sheet_text", _SQL_SHEET + f"""
, lines AS (
  SELECT record_id, rank, 0 AS ln, '  ' || rank || '. ' || neighbour || ' [' || neighbour_label || '] cosine=' || printf('%.3f', cosine) AS line FROM sheet
  UNION ALL SELECT record_id, rank, 1, '     source: ' || source_45 || '  |  lang: ' || lang FROM sheet
  UNION ALL SELECT record_id, rank, 2, '     text: ' || text_60 FROM sheet
  UNION ALL SELECT DISTINCT record_id, 0, 0, name || ' (' || set_name || ')  |  P=' || printf('%.3f', p) || '  |  ' || call_name || ' at t={OPT_THRESHOLD}' FROM sheet)
SELECT record_id, string_agg(line, chr(10) ORDER BY rank, ln) AS report FROM lines GROUP BY record_id""")
def neighbour_sheet_text(spark, sf_dir):
    from ..sources.sinks import text_blocks
    three = lambda c: F.format_string("%.3f", F.col(c))
    lines = [
        (F.col("rank"), F.lit(0), F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), "neighbour", F.lit(" ["), "neighbour_label",
                                           F.lit("] cosine="), three("cosine"))),
        (F.col("rank"), F.lit(1), F.concat(F.lit("     source: "), "source_45", F.lit("  |  lang: "), "lang")),
        (F.col("rank"), F.lit(2), F.concat(F.lit("     text: "), "text_60")),
    ]
    header = F.concat("name", F.lit(" ("), "set_name", F.lit(")  |  P="), three("p"), F.lit("  |  "), "call_name", F.lit(f" at t={OPT_THRESHOLD}"))
    return text_blocks(_neighbour_sheet(spark, sf_dir), "record_id", header, lines, head_cols=["name", "set_name", "p", "call_name"])


# --------------------------------------------------------------------------- V10: both classes on one map
@register("class_points", _with(sv.scored()) + f"""
SELECT record_id, CASE WHEN y = 1 THEN 'induction' ELSE 'inhibition' END AS class_name,
       {MAP_SCALE}::DOUBLE * cos1 AS x, {MAP_SCALE}::DOUBLE * cos0 AS y FROM scored WHERE split = 'train'""")
def class_points(spark, sf_dir):
    """Every labelled training record on the map, with the name of its class."""
    s = ad.scored(spark, sf_dir).filter(F.col("split") == "train")
    return s.select("record_id", class_name("y").alias("class_name"), (F.lit(MAP_SCALE) * F.col("cos1")).alias("x"),
                    (F.lit(MAP_SCALE) * F.col("cos0")).alias("y"))
