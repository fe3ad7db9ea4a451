"""Queries for readers, writers and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import hash32, normalised_path, round_to, run_name, label_line
from ..session import scratch_path
from ..sources import readers as I, sinks as K, testdata as td
from .splits import MESSY_MAN, NORM, messy
from .screening import ATTEMPTS, CONTENT, SLOG, extraction, log
from .thresholds import COARSE_GRID, FINE_GRID, coarse_sweep, counts_sql, fine_sweep, images, sweep_sql
from .views import CURVE, IMAGES, MANIFEST, SCREEN, TRUTH, h, rnd, with_

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def stored_manifest(s, d) -> str:
    path = scratch_path(s, "manifest")
    K.write_manifest(td.manifest(s, d), path)
    return path


register(
    "S1_read_manifest",
    lambda s, d: I.read_manifest(s, stored_manifest(s, d)).unionByName(
        I.read_manifest(s, scratch_path(s, "absent"))
    ),
    with_(MANIFEST) + "SELECT role, category, path FROM man",
)

SUFFIXES = [".JPG", ".jpeg", ".png", ".txt", ".WebP", ".gif", ".bmp", ""]


def file_names(s, d) -> DataFrame:
    """(page_id, path): page addresses without query, with a hashed file suffix."""
    ext = F.element_at(
        F.array(*[F.lit(x) for x in SUFFIXES]), (hash32(F.lit("ext"), F.col("page_id")) % 8 + 1).cast("int")
    )
    return td.table(s, d, "pages").select(
        "page_id", F.concat(F.regexp_replace("url", r"[?#].*$|/$|\.html$", ""), ext).alias("path")
    )


FILES = f"""files AS (
  SELECT page_id, regexp_replace(url, '[?#].*$|/$|\\.html$', '', 'g')
         || ({SUFFIXES!r})[{h('ext', 'page_id')} % 8 + 1] AS path FROM pages)"""
register(
    "S2_list_images",
    lambda s, d: file_names(s, d).filter(I.is_image(F.col("path"))),
    with_(FILES) + r"""SELECT page_id, path FROM files
WHERE regexp_matches(split_part(path, '/', -1), '(?i).\.(jpg|jpeg|png|webp|bmp)$')""",
)
register(
    "S3_directory_category",
    lambda s, d: I.with_directory_category(file_names(s, d), ["en", "de"]),
    with_(FILES) + """SELECT page_id, path, split_part(path, '/', -2) AS category FROM files
WHERE split_part(path, '/', -2) NOT IN ('en', 'de')""",
)


def curated_names(s, d) -> DataFrame:
    """(p_partkey, path): flat file names in the spellings found in a hand-made collection."""
    kind = hash32(F.lit("name"), F.col("p_partkey")) % 5
    key = F.col("p_partkey").cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lower("p_type"), F.lit(" "), key))
        .when(kind == 1, F.concat(F.lower("p_type"), F.lit("_part_"), key))
        .when(kind == 2, F.concat(F.lit("images ("), key, F.lit(")")))
        .when(kind == 3, F.concat(F.lit("old_"), F.lower("p_brand"), F.lit(" x_"), key))
        .otherwise(F.concat(F.lit("photo."), F.lower("p_type")))
    )
    return td.table(s, d, "part").select("p_partkey", F.concat(F.lit("raw/flat/"), name, F.lit(".jpg")).alias("path"))


def overrides(s, d) -> DataFrame:
    """Hand-assigned categories: every bracketed name with a size of at most ten."""
    named = curated_names(s, d).join(td.table(s, d, "part").filter("p_size <= 10").select("p_partkey", "p_brand"), "p_partkey")
    return named.filter(F.col("path").contains("images (")).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("p_brand").alias("override")
    )


NAMES = f"""names AS (
  SELECT p_partkey, p_size, p_brand, 'raw/flat/' || CASE {h('name', 'p_partkey')} % 5
    WHEN 0 THEN lower(p_type) || ' ' || p_partkey::VARCHAR
    WHEN 1 THEN lower(p_type) || '_part_' || p_partkey::VARCHAR
    WHEN 2 THEN 'images (' || p_partkey::VARCHAR || ')'
    WHEN 3 THEN 'old_' || lower(p_brand) || ' x_' || p_partkey::VARCHAR
    ELSE 'photo.' || lower(p_type) END || '.jpg' AS path FROM part),
stems AS (SELECT *, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem FROM names)"""
register(
    "S4_curated_category",
    lambda s, d: I.with_curated_category(curated_names(s, d), overrides(s, d)),
    with_(NAMES)
    + r"""SELECT p_partkey, path, CASE WHEN stem LIKE 'images (%' AND p_size <= 10 THEN p_brand ELSE
  trim(replace(CASE WHEN regexp_matches(stem, ' [0-9]+$') THEN regexp_replace(stem, ' [0-9]+$', '')
    WHEN regexp_matches(stem, '_[0-9]+$') THEN regexp_replace(stem, '_[0-9]+$', '') ELSE stem END, '_', ' '))
  END AS category FROM stems""",
)
register(
    "S5_normalised_path",
    lambda s, d: messy(s, d).select("doc_id", normalised_path("path").alias("path")),
    with_(MESSY_MAN) + f"SELECT doc_id, {NORM} AS path FROM man",
)


def summaries(s, d) -> DataFrame:
    """(event_id, text): event properties, some cut short, some missing."""
    cut = hash32(F.lit("cut"), F.col("event_id")) % 10
    return td.table(s, d, "events").select(
        "event_id",
        F.when(cut < 2, F.expr("substring(props, 1, length(props) - 1)")).when(cut > 2, F.col("props")).alias("text"),
    )


TEXTS = f"""texts AS (
  SELECT event_id, CASE WHEN c < 2 THEN left(props, length(props) - 1) WHEN c > 2 THEN props END AS text
  FROM (SELECT *, {h('cut', 'event_id')} % 10 AS c FROM events))"""
register(
    "S6_json_or_null",
    lambda s, d: summaries(s, d).select("event_id", I.json_or_null(F.col("text"), "k bigint")["k"].alias("k")),
    with_(TEXTS)
    + "SELECT event_id, CASE WHEN json_valid(text) THEN (text::JSON->>'k')::BIGINT END AS k FROM texts",
)
register(
    "S7_nested_defaults",
    lambda s, d: td.table(s, d, "events").select(
        "event_id", I.json_number(F.col("props"), "$.k").alias("k"),
        I.json_number(F.col("props"), "$.capacity.n_params", -1.0).alias("n_params"),
    ),
    "SELECT event_id, (props::JSON->>'k')::DOUBLE AS k, coalesce((props::JSON->'capacity'->>'n_params')::DOUBLE, -1.0::DOUBLE) AS n_params FROM events",
)


def label_lines(s, d) -> DataFrame:
    """(image_id, line_no, line): the label line of each truth, with junk lines and lost labels."""
    t = td.truths(s, d).withColumn("line", label_line("x0", "y0", "x1", "y1"))
    kind = hash32(F.lit("junk"), F.col("image_id")) % 4
    lines = (
        F.when(kind == 0, F.array(F.lit(""), F.col("line")))
        .when(kind == 1, F.array(F.lit("0 0.5 0.5"), F.concat(F.lit("  "), F.col("line"))))
        .when(kind == 2, F.array(F.lit("0 0.5 0.5 0.1")))
        .otherwise(F.array("line"))
    )
    return t.select("image_id", F.posexplode(lines).alias("line_no", "line"))


def sizes(s, d) -> DataFrame:
    return td.photo_roles(s, d).select("image_id", F.lit(640.0).alias("width"), F.lit(640.0).alias("height"))


LABELS = f"""lab AS (
  SELECT image_id, {h('junk', 'image_id')} % 4 AS junk,
         {rnd('(x0 + x1)::DOUBLE / 2 / 640.0::DOUBLE', 6)} AS cx, {rnd('(y0 + y1)::DOUBLE / 2 / 640.0::DOUBLE', 6)} AS cy,
         {rnd('(x1 - x0)::DOUBLE / 640.0::DOUBLE', 6)} AS bw, {rnd('(y1 - y0)::DOUBLE / 640.0::DOUBLE', 6)} AS bh
  FROM truth)"""


def labels_query(s, d) -> DataFrame:
    out = I.parse_labels(label_lines(s, d), sizes(s, d))
    return out.select("image_id", "line_no", *[round_to(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


register(
    "S8_read_labels",
    labels_query,
    with_(TRUTH, LABELS)
    + f"""SELECT o_orderkey AS image_id, CASE WHEN junk IN (0, 1) THEN 1 WHEN junk = 3 THEN 0 END AS line_no,
  {rnd('(cx - bw / 2) * 640', 6)} AS x0, {rnd('(cy - bh / 2) * 640', 6)} AS y0,
  {rnd('(cx + bw / 2) * 640', 6)} AS x1, {rnd('(cy + bh / 2) * 640', 6)} AS y1
FROM orders LEFT JOIN (SELECT * FROM lab WHERE junk <> 2) y ON image_id = o_orderkey""",
)
register(
    "S9_label_lines",
    lambda s, d: td.truths(s, d).select("image_id", label_line("x0", "y0", "x1", "y1").alias("line")),
    with_(TRUTH, LABELS)
    + "SELECT image_id, printf('0 %.6f %.6f %.6f %.6f', cx, cy, bw, bh) AS line FROM lab",
)


def stored_curve(s, d) -> DataFrame:
    path = scratch_path(s, "curve")
    metric = "metrics/mAP50-95(B)"
    td.curve(s, d).select(
        "arm", F.col("epoch").alias("   epoch"), F.col("metric").alias(f"      {metric}")
    ).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return I.read_training_curve(s, path, metric)


register(
    "S10_read_training_curve",
    stored_curve,
    with_(CURVE) + "SELECT arm, epoch, metric FROM curve",
)


def stored_scores(s, d) -> DataFrame:
    path = scratch_path(s, "per_image")
    rows = images(s, d).select(
        "role", "category", F.concat_ws("/", "arm", F.col("image_id").cast("string")).alias("path"), "n_boxes", "max_conf"
    )
    K.write_table(rows, path)
    return I.read_per_image(s, path)


register(
    "S11_blank_is_null",
    stored_scores,
    with_(IMAGES)
    + "SELECT role, category, arm || '/' || image_id::VARCHAR AS path, n_boxes::INT AS n_boxes, max_conf FROM img",
)


def written(s, d) -> DataFrame:
    """Rows found again after writing a manifest, a fine sweep, an F1 curve and a summary."""
    sweep_path, curve_path, summary_path = (scratch_path(s, n) for n in ("sweep", "f1", "summary"))
    rows = fine_sweep(s, d)
    K.write_table(rows, sweep_path)
    K.write_f1_curve(rows, curve_path)
    K.write_summary(K.split_summary(td.manifest(s, d), 0), summary_path)
    count = lambda df, what: df.agg(F.lit(what).alias("sink"), F.count(F.lit(1)).alias("n"))
    return (
        count(I.read_manifest(s, stored_manifest(s, d)), "manifest")
        .unionByName(count(s.read.csv(sweep_path, header=True), "sweep"))
        .unionByName(count(s.read.csv(curve_path, header=True), "f1_curve"))
        .unionByName(count(s.read.json(summary_path), "summary"))
    )


register(
    "S12_write_and_recount",
    written,
    """SELECT 'manifest' AS sink, count(*) AS n FROM documents UNION ALL SELECT 'sweep', 159 * count(DISTINCT l_suppkey % 4) FROM lineitem
UNION ALL SELECT 'f1_curve', 159 * count(DISTINCT l_suppkey % 4) FROM lineitem UNION ALL SELECT 'summary', 1""",
)


def sinks_read_back(s, d) -> DataFrame:
    """Every sink written, read again with the table's own types, and compared."""
    per_image = images(s, d).select(
        "role", "category", F.concat_ws("/", "arm", F.col("image_id").cast("string")).alias("path"), "n_boxes", "max_conf"
    )
    sweep = fine_sweep(s, d)
    screened = log(s, d).select(
        "item", "category", round_to("solid", 4).alias("solid"), round_to("haze", 4).alias("haze"), "person",
        "n_devices", "dominant", "verdict", "reason",
    )
    table = lambda rows, path: s.read.csv(path, schema=rows.schema, header=True, nullValue="", emptyValue="")
    tables = {
        "extraction log": extraction(s, d), "screening log": screened, "coarse sweep": coarse_sweep(s, d),
        "fine sweep": sweep, "per image": per_image,
    }
    sinks = [(name, rows, K.write_table, table) for name, rows in tables.items()]
    sinks += [
        ("manifest", td.manifest(s, d).select("role", "category", "path"), K.write_manifest, lambda rows, path: I.read_manifest(s, path)),
        ("f1 curve", sweep.select("confidence", "f1"), K.write_f1_curve, table),
        ("summary", K.split_summary(td.manifest(s, d), 0), K.write_summary, lambda rows, path: s.read.schema(rows.schema).json(path)),
    ]
    out = None
    for name, rows, write, read in sinks:
        path = scratch_path(s, "sink")
        got = K.read_back(rows, lambda r: write(r, path), lambda: read(rows, path)).withColumn("sink", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def digest_sql(sink: str, ctes: str, source: str, columns: list[str], doubles: str = "") -> str:
    text = lambda c: f"coalesce(printf('%.6f', {rnd(c, 6)}), '')" if c in doubles.split() else f"coalesce(({c})::VARCHAR, '')"
    hashed = h("row", ", ".join(text(c) for c in columns))
    return f"SELECT * FROM ({ctes}SELECT '{sink}' AS sink, count(*) AS n, sum({hashed})::BIGINT AS digest, true AS same FROM {source})"


_RATES = "confidence fa_rate fa_boxes_per_image detection_rate precision recall f1 detect_low detect_high fa_low fa_high"
_SWEEP = """arm confidence neg_images_fired neg_boxes fa_rate fa_boxes_per_image pos_images_fired detection_rate precision
recall f1 detect_low detect_high fa_low fa_high""".split()
_FINE, _COARSE = (with_(IMAGES, grid, counts_sql(), sweep_sql()) for grid in (FINE_GRID, COARSE_GRID))
_SUMMARY = """(SELECT 0 AS seed, (SELECT '{' || string_agg('"' || role || '":' || n::VARCHAR, ',' ORDER BY role) || '}'
    FROM (SELECT role, count(*) AS n FROM man GROUP BY role)) AS counts,
  (SELECT '[' || string_agg(DISTINCT '"' || category || '"', ',' ORDER BY '"' || category || '"') || ']' FROM man) AS categories)"""
register(
    "S12_sinks_read_back",
    sinks_read_back,
    " UNION ALL ".join([
        digest_sql("manifest", with_(MANIFEST), "man", ["role", "category", "path"]),
        digest_sql("extraction log", with_(ATTEMPTS), "elog", ["role", "category", "source_path", "output", "kept", "reason"]),
        digest_sql(
            "screening log", with_(SCREEN, CONTENT, SLOG),
            f"(SELECT * REPLACE ({rnd('solid', 4)} AS solid, {rnd('haze', 4)} AS haze) FROM vlog)",
            ["item", "category", "solid", "haze", "person", "n_devices", "dominant", "verdict", "reason"], "solid haze",
        ),
        digest_sql("coarse sweep", _COARSE, "sweep", _SWEEP, _RATES),
        digest_sql("fine sweep", _FINE, "sweep", _SWEEP, _RATES),
        digest_sql("f1 curve", _FINE, "sweep", ["confidence", "f1"], _RATES),
        digest_sql(
            "per image", with_(IMAGES), "(SELECT *, arm || '/' || image_id::VARCHAR AS path FROM img)",
            ["role", "category", "path", "n_boxes", "max_conf"], "max_conf",
        ),
        digest_sql("summary", with_(MANIFEST), _SUMMARY, ["seed", "counts", "categories"]),
    ]),
)


def runs(s, d) -> DataFrame:
    p = td.table(s, d, "part")
    tag = F.when(F.col("p_size") > 25, F.translate(F.lower("p_brand"), "#", "_"))
    return p.select("p_partkey", F.col("p_size").alias("pool"), tag.alias("tag"), (F.col("p_partkey") % 3).alias("seed"))


RUNS = """runs AS (
  SELECT p_partkey, 'pool' || p_size::VARCHAR || CASE WHEN p_size > 25 THEN '_' || translate(lower(p_brand), '#', '_') ELSE '' END
    || CASE WHEN p_partkey % 3 <> 0 THEN '_s' || (p_partkey % 3)::VARCHAR ELSE '' END AS run FROM part)"""
register(
    "S13_run_names",
    lambda s, d: runs(s, d).select("p_partkey", run_name("pool", "tag", "seed").alias("run")),
    with_(RUNS) + "SELECT * FROM runs",
)
register(
    "S13_repeated_run_names",
    lambda s, d: runs(s, d).groupBy(run_name("pool", "tag", "seed").alias("run")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    with_(RUNS) + "SELECT run, count(*) AS n FROM runs GROUP BY 1 HAVING count(*) > 1",
)
