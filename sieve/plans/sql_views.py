"""SQL text (DuckDB dialect) of the driver-table adapters, for the oracle queries.

Each function returns a ``WITH`` list (without the leading ``WITH``) that defines
the same relation the Spark adapter builds; oracle queries append to it.
"""

from __future__ import annotations

from ..functions.text import CLASS_TAG, NAME_DIGITS, NAME_PAREN_SPAN, WS, WS_RUN, unicode_classes
from ..operators.moments import REFIT_DIGITS, SCORE_DIGITS, SCORE_SCALE
from ..operators.split import SPLIT_SEED, TEST_SIZE
from ..sources.adapters import POSITIVE_FROM_LABEL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def clean_name(e: str) -> str:
    s = strip_ws(e)
    s = f"regexp_replace({s}, {lit(NAME_PAREN_SPAN)}, '', 'g')"
    s = f"regexp_replace({s}, {lit(unicode_classes(NAME_DIGITS))}, '', 'g')"
    s = f"regexp_replace({s}, {lit(unicode_classes(WS_RUN))}, ' ', 'g')"
    return strip_ws(s)


def clean_tag(e: str) -> str:
    return strip_ws(f"regexp_replace({strip_ws(e)}, {lit(unicode_classes(CLASS_TAG))}, '', 'g')")


def normalize_missing(e: str) -> str:
    return f"CASE WHEN {e} IS NULL OR CAST({e} AS VARCHAR) IN ('ND', '') THEN 'Unknown' ELSE CAST({e} AS VARCHAR) END"


def md5_long(*parts: str) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def md5_index(*parts: str) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT)"


def md5_unit(*parts: str) -> str:
    return f"({md5_long(*parts)} / 4294967296.0::DOUBLE)"


def md5_key(*parts: str) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5({key})"


def records() -> str:
    return """records AS (
  SELECT d.doc_id AS record_id, d.lang, d.source, CAST(d.n_chars AS VARCHAR) AS n_chars, d.text,
         l.quality AS target
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def parts() -> str:
    return """parts AS (
  SELECT p_partkey AS record_id, p_name, p_brand, p_type, p_size FROM part)"""


def holdout(src: str, name: str, label: str = "y", id_col: str = "record_id",
            test_size: float = TEST_SIZE, seed: int = SPLIT_SEED) -> str:
    """Stratified hold-out over relation ``src`` -> relation ``name`` with ``split``."""
    return f"""{name}_cc AS (SELECT {label}, count(*) AS n_class FROM {src} GROUP BY {label}),
{name}_q0 AS (
  SELECT {label}, n_class, sum(n_class) OVER () AS n,
         sum(n_class) OVER () - ceil({test_size}::DOUBLE * sum(n_class) OVER ()) AS n_train
  FROM {name}_cc),
{name}_q1 AS (
  SELECT {label}, floor(n_train * n_class / n) AS fl,
         n_train * n_class / n - floor(n_train * n_class / n) AS rem,
         n_train - sum(floor(n_train * n_class / n)) OVER () AS need
  FROM {name}_q0),
{name}_q AS (
  SELECT {label}, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, {label}) <= need THEN 1 ELSE 0 END AS train_quota
  FROM {name}_q1),
{name} AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.{label} ORDER BY {md5_key(seed, 's.' + id_col)}, s.{id_col})
                        <= q.train_quota THEN 'train' ELSE 'test' END AS split
  FROM {src} s JOIN {name}_q q ON s.{label} = q.{label})"""


def vectors() -> str:
    return f"""vec0 AS (
  SELECT vec_id AS record_id, CAST(embedding AS DOUBLE[]) AS embedding,
         CAST(label >= {POSITIVE_FROM_LABEL} AS INTEGER) AS y
  FROM embeddings),
{holdout('vec0', 'vectors')}"""


def cosine(a: str, b: str) -> str:
    return (f"CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END")


def scored() -> str:
    return f"""{vectors()},
cen_el AS (
  SELECT y, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM vectors WHERE split = 'train'),
cen AS (
  SELECT y, list(m ORDER BY dim) AS centroid FROM (SELECT y, dim, avg(x) AS m FROM cen_el GROUP BY y, dim) GROUP BY y),
sc0 AS (
  SELECT v.record_id, v.embedding, v.y, v.split,
         {cosine('v.embedding', 'c1.centroid')} AS cos1,
         {cosine('v.embedding', 'c0.centroid')} AS cos0
  FROM vectors v, (SELECT centroid FROM cen WHERE y = 1) c1, (SELECT centroid FROM cen WHERE y = 0) c0),
scored AS (
  SELECT record_id, embedding, y, split, cos1, cos0,
         round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({SCORE_SCALE}::DOUBLE * (cos1 - cos0)))), {SCORE_DIGITS}) AS p
  FROM sc0)"""


def kfold(src: str, name: str, seeds, k: int, label: str = "y", id_col: str = "record_id",
          seed_col: str = "seed") -> str:
    seeds_list = ", ".join(str(int(s)) for s in seeds)
    return f"""{name}_x AS (SELECT s.*, sd.{seed_col} FROM {src} s, (SELECT unnest([{seeds_list}]) AS {seed_col}) sd),
{name}_cc AS (SELECT {seed_col}, {label}, count(*) AS n_class FROM {name}_x GROUP BY ALL),
{name}_off AS (
  SELECT {seed_col}, {label},
         coalesce(sum(n_class) OVER (PARTITION BY {seed_col} ORDER BY {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM {name}_cc),
{name} AS (
  SELECT x.*, CAST((o.off + row_number() OVER (PARTITION BY x.{seed_col}, x.{label}
                    ORDER BY {md5_key('x.' + seed_col, 'x.' + id_col)}, x.{id_col}) - 1) % {k} AS INTEGER) AS fold
  FROM {name}_x x JOIN {name}_off o ON x.{seed_col} = o.{seed_col} AND x.{label} = o.{label})"""


def grid(grids: dict | None = None) -> str:
    """(family, grid_pos, params) by crossing the value lists of each sub-grid."""
    import json

    from ..operators.selection import GRIDS
    parts_sql = []
    for family, subgrids in (grids or GRIDS).items():
        offset = 0
        for sub in subgrids:
            keys = list(sub)
            froms, pos, body = [], "0", []
            for i, k in enumerate(keys):
                vals = ", ".join(lit(json.dumps(v)) for v in sub[k])
                froms.append(f"(SELECT unnest([{vals}]) AS v{i}, generate_subscripts([{vals}], 1) - 1 AS i{i}) t{i}")
                pos = f"({pos}) * {len(sub[k])} + i{i}"
                body.append(f"{lit(json.dumps(k) + ':')} || v{i}")
            parts_sql.append(f"SELECT {lit(family)} AS family, CAST({offset} + {pos} AS INTEGER) AS grid_pos, "
                             f"'{{' || {' || \',\' || '.join(body)} || '}}' AS params FROM {', '.join(froms)}")
            n = 1
            for k in keys:
                n *= len(sub[k])
            offset += n
    return "grid AS (\n  " + "\n  UNION ALL ".join(parts_sql) + ")"


def unit_encodings(src: str, name: str) -> str:
    """The three encodings of the vectors of ``src``, scaled to length one."""
    return f"""{name}_raw AS (
  SELECT record_id, y, 'domain' AS encoder, embedding AS x FROM {src}
  UNION ALL SELECT record_id, y, 'general', list_transform(embedding, lambda v: CAST(sign(v) AS DOUBLE)) FROM {src}
  UNION ALL SELECT record_id, y, 'half', list_transform(embedding, lambda v, i: CASE WHEN i - 1 < len(embedding) / 2.0 THEN v ELSE 0.0::DOUBLE END) FROM {src}),
{name} AS MATERIALIZED (
  SELECT record_id, y, encoder, CASE WHEN l = 0 THEN x ELSE list_transform(x, lambda v: v / l) END AS x
  FROM (SELECT *, sqrt(list_dot_product(x, x)) AS l FROM {name}_raw))"""


def linear_models(training: str, keys: str, name: str) -> str:
    """Every setting of the closed-form grid fitted on the rows of ``training``
    (keys..., y, x), for each value of ``keys``."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    par = lambda k: f"coalesce(CAST(json_extract_string(params, '$.{k}') AS DOUBLE), 0.0) AS {k}"
    return f"""{name}_el AS (SELECT {keys}, y, generate_subscripts(x, 1) AS dim, unnest(x) AS v FROM {training}),
{name}_mom AS (SELECT {keys}, y, dim, count(*) AS n, avg(v) AS c, sum(v * v) AS q FROM {name}_el GROUP BY ALL),
{name}_dim AS (
  SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.dim, a.n AS n1, b.n AS n0, a.c AS c1, b.c AS c0, (a.n * a.c + b.n * b.c) / (a.n + b.n) AS m,
         greatest((a.q + b.q - a.n * a.c * a.c - b.n * b.c * b.c) / (a.n + b.n), 0.0) AS v
  FROM {name}_mom a JOIN {name}_mom b ON {on('a', 'b')} AND a.dim = b.dim AND a.y = 1 AND b.y = 0),
{name}_sp AS (SELECT *, avg(v) OVER (PARTITION BY {keys}) AS vbar FROM {name}_dim),
{name}_set AS (SELECT family, grid_pos, {par('scale')}, {par('shrink')}, {par('reg')}, {par('prior')} FROM grid),
{name}_e AS (
  SELECT *, (1.0 - shrink) * c1 + shrink * m AS e1, (1.0 - shrink) * c0 + shrink * m AS e0,
         CASE WHEN family = 'Mean difference' THEN 1.0::DOUBLE WHEN v + reg * vbar > 0 THEN 1.0::DOUBLE / (v + reg * vbar) ELSE 0.0::DOUBLE END AS w
  FROM {name}_sp, {name}_set),
{name}_l AS (
  SELECT *, sqrt(sum(e1 * e1) OVER g) AS l1, sqrt(sum(e0 * e0) OVER g) AS l0, sum((c1 * c1 - c0 * c0) * w) OVER g AS middle
  FROM {name}_e WINDOW g AS (PARTITION BY {keys}, family, grid_pos)),
{name} AS MATERIALIZED (
  SELECT {keys}, family, grid_pos,
         list(CASE WHEN family = 'Centroid cosine'
                   THEN scale * (CASE WHEN l1 = 0 THEN 0.0 ELSE e1 / l1 END - CASE WHEN l0 = 0 THEN 0.0 ELSE e0 / l0 END)
                   ELSE scale * (c1 - c0) * w END ORDER BY dim) AS u,
         any_value(CASE WHEN family = 'Centroid cosine' THEN 0.0 ELSE prior * ln(n1 / n0) - scale * 0.5 * middle END) AS b
  FROM {name}_l GROUP BY {keys}, family, grid_pos)"""


def linear_p(x: str, model: str) -> str:
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(list_dot_product({x}, {model}.u) + {model}.b))), {REFIT_DIGITS})"


def sweep_scores() -> str:
    from ..operators.linear_grid import LINEAR_GRIDS
    from ..operators.split import CV_FOLDS, CV_SEEDS
    return f"""{vectors()},
sw_src AS (SELECT record_id, y, embedding FROM vectors WHERE split = 'train'),
sw_id AS (SELECT record_id, y FROM sw_src),
{kfold('sw_id', 'sw_folds', CV_SEEDS, CV_FOLDS)},
{grid(LINEAR_GRIDS)},
{unit_encodings('sw_src', 'sw_x')},
sw_train AS (
  SELECT x.encoder, f.seed, k.fold, x.y, x.x FROM sw_folds f JOIN range({CV_FOLDS}) k(fold) ON f.fold <> k.fold JOIN sw_x x ON x.record_id = f.record_id),
{linear_models('sw_train', 'encoder, seed, fold', 'sw_model')},
sweep AS MATERIALIZED (
  SELECT x.encoder, m.family, f.seed, m.grid_pos, f.fold, f.record_id, f.y, {linear_p('x.x', 'm')} AS p
  FROM sw_folds f JOIN sw_x x ON x.record_id = f.record_id
  JOIN sw_model m ON m.encoder = x.encoder AND m.seed = f.seed AND m.fold = f.fold)"""


def screen_set() -> str:
    from ..sources.adapters import GROUP_SHARE
    return f"""{scored()},
screen AS (
  SELECT record_id, CASE WHEN {md5_unit("'group'", 'record_id')} < {GROUP_SHARE} THEN 'validation' ELSE 'screen' END AS grp,
         'rec' || CAST(record_id AS VARCHAR) AS name, y, p, embedding, cos1, cos0
  FROM scored WHERE split = 'test')"""


def boot_counts() -> str:
    """The exact bootstrap: candidates in rounds, the first N_BOOT of two classes."""
    from ..operators import resample as rs
    candidates = rs.N_BOOT + max(10, rs.N_BOOT // 10)
    return f"""bsrc AS (SELECT record_id, y FROM vectors WHERE split = 'train'),
bidx AS (SELECT record_id, y, row_number() OVER (ORDER BY {md5_key(rs.BOOT_SEED, 'record_id')}, record_id) - 1 AS row_idx FROM bsrc),
bn AS (SELECT count(*) AS n FROM bsrc),
bdraws AS (SELECT replicate, unnest(range(n)) AS draw, n FROM range({candidates}) r(replicate), bn),
bcnt AS (SELECT replicate, {md5_index(rs.BOOT_SEED, 'replicate', 'draw')} % n AS row_idx, count(*) AS draws
         FROM bdraws GROUP BY ALL),
bj AS (SELECT c.replicate, i.record_id, i.y, c.draws FROM bcnt c JOIN bidx i ON c.row_idx = i.row_idx),
bok AS (SELECT replicate FROM bj GROUP BY replicate HAVING count(DISTINCT y) >= 2 ORDER BY replicate LIMIT {rs.N_BOOT}),
bnum AS (SELECT replicate, row_number() OVER (ORDER BY replicate) - 1 AS number FROM bok),
bcounts AS MATERIALIZED (SELECT bnum.number AS replicate, bj.record_id, bj.draws FROM bj JOIN bnum USING (replicate))"""


def refit_p(vec: str) -> str:
    """Score of ``vec`` under the centroids c1.centroid, c0.centroid."""
    return (f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({SCORE_SCALE}::DOUBLE * ({cosine(vec, 'c1.centroid')} "
            f"- {cosine(vec, 'c0.centroid')})))), {REFIT_DIGITS})")


def boot_scores() -> str:
    return f"""{screen_set()},
{boot_counts()},
bel AS (
  SELECT b.replicate, v.y, b.draws, generate_subscripts(v.embedding, 1) AS dim, unnest(v.embedding) AS x
  FROM bcounts b JOIN vectors v ON b.record_id = v.record_id),
bcen AS MATERIALIZED (
  SELECT replicate, y, list(m ORDER BY dim) AS centroid
  FROM (SELECT replicate, y, dim, sum(x * draws) / sum(draws) AS m FROM bel GROUP BY replicate, y, dim) GROUP BY replicate, y),
boot AS MATERIALIZED (
  SELECT c1.replicate, s.record_id, s.grp, s.name, {refit_p('s.embedding')} AS p
  FROM screen s, (SELECT * FROM bcen WHERE y = 1) c1 JOIN (SELECT * FROM bcen WHERE y = 0) c0 ON c1.replicate = c0.replicate)"""


def oof_scores() -> str:
    from ..operators.split import OOF_FOLDS, OOF_REPEATS, SPLIT_SEED
    seeds = [SPLIT_SEED * 1000 + r for r in range(OOF_REPEATS)]
    return f"""{vectors()},
oof_src AS (SELECT record_id, y FROM vectors),
{kfold('oof_src', 'oof_f', seeds, OOF_FOLDS, seed_col='rseed')},
oof_el AS (
  SELECT f.rseed, k.fold, f.y, generate_subscripts(v.embedding, 1) AS dim, unnest(v.embedding) AS x
  FROM oof_f f JOIN range({OOF_FOLDS}) k(fold) ON f.fold <> k.fold JOIN vectors v ON f.record_id = v.record_id),
oof_cen AS MATERIALIZED (
  SELECT rseed, fold, y, list(m ORDER BY dim) AS centroid
  FROM (SELECT rseed, fold, y, dim, avg(x) AS m FROM oof_el GROUP BY rseed, fold, y, dim) GROUP BY rseed, fold, y),
oof AS MATERIALIZED (
  SELECT CAST(f.rseed - {SPLIT_SEED * 1000} AS INTEGER) AS repeat, f.fold, f.record_id, f.y, {refit_p('v.embedding')} AS p
  FROM oof_f f JOIN vectors v ON f.record_id = v.record_id
  JOIN oof_cen c1 ON c1.rseed = f.rseed AND c1.fold = f.fold AND c1.y = 1
  JOIN oof_cen c0 ON c0.rseed = f.rseed AND c0.fold = f.fold AND c0.y = 0)"""
