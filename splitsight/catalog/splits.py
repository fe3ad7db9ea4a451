"""Queries for draws, duplicates and the disjointness audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import base_name, hamming, hash32, keyed_hash
from ..operators import audit as U, dedup as Q, draws as D
from ..sources import testdata as td
from .views import HAMMING, HASHES, MANIFEST, h, with_

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


TAKE, CHAIN, SELECT = 150, [("bg", 50), ("clutter", 40)], 120
NESTED = [25, 100, 150]


def parts(s, d) -> DataFrame:
    return td.table(s, d, "part").select("p_partkey", F.col("p_type").alias("category"))


PARTS = "items AS (SELECT p_partkey, p_type AS category FROM part)"


def alloc_sql(sizes: str, n: str, tie: str = "category", size: str = "size") -> str:
    """Largest remainder over a (category, size) relation."""
    return f"""(SELECT *, fl + (row_number() OVER (ORDER BY rem DESC, {tie}) <= {n} - sum(fl) OVER ())::BIGINT AS alloc
  FROM (SELECT *, ({n} * {size}::HUGEINT // sum({size}) OVER ())::BIGINT AS fl,
               ({n} * {size}::HUGEINT) % sum({size}) OVER () AS rem FROM {sizes}))"""


def key_sql(stage: str, col: str) -> str:
    return f"md5(concat_ws('|', '0', '{stage}', {col}))"


SIZES = "sizes AS (SELECT category, count(*) AS size FROM items GROUP BY 1)"
register(
    "D1_largest_remainder",
    lambda s, d: D.largest_remainder(D.category_sizes(parts(s, d)), TAKE),
    with_(PARTS, SIZES) + f"SELECT category, size, alloc FROM {alloc_sql('sizes', str(TAKE))}",
)
register(
    "D2_stratified_take",
    lambda s, d: D.stratified_take(parts(s, d), TAKE, "p_partkey"),
    with_(PARTS, SIZES, f"al AS (SELECT * FROM {alloc_sql('sizes', str(TAKE))})")
    + f"""SELECT p_partkey, category FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY {key_sql('take', 'p_partkey')}, p_partkey) AS rn
  FROM items JOIN al USING (category)) WHERE rn <= alloc""",
)
register(
    "D3_chained_draws",
    lambda s, d: D.chained_draws(parts(s, d), CHAIN, "rest", "p_partkey"),
    with_(
        PARTS, SIZES, f"a1 AS (SELECT category, size, alloc AS t1 FROM {alloc_sql('sizes', '50')})",
        "s2 AS (SELECT category, t1, size - t1 AS size FROM a1)",
        f"a2 AS (SELECT category, t1, alloc AS t2 FROM {alloc_sql('s2', '40')})",
    )
    + f"""SELECT p_partkey, category, CASE WHEN rn <= t1 THEN 'bg' WHEN rn <= t1 + t2 THEN 'clutter' ELSE 'rest' END AS role
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {key_sql('chain', 'p_partkey')}, p_partkey) AS rn
  FROM items JOIN a2 USING (category))""",
)


def named(s, d) -> DataFrame:
    return td.manifest(s, d).withColumn("name", base_name("path"))


def curated(s, d) -> DataFrame:
    return named(s, d).filter("role = 'pool'")


register(
    "D4_exclude_curated",
    lambda s, d: D.exclude_by_name(named(s, d), curated(s, d), "name").select("doc_id", "role", "category", "path"),
    with_(MANIFEST)
    + """SELECT doc_id, role, category, path FROM man
WHERE split_part(path, '/', 2) NOT IN (SELECT split_part(path, '/', 2) FROM man WHERE role = 'pool')""",
)
register(
    "D4_excluded_count",
    lambda s, d: D.excluded_count(named(s, d), curated(s, d), "name"),
    with_(MANIFEST)
    + """SELECT category, count(*) FILTER (x) AS n_excluded, count(*) FILTER (NOT x) AS n_kept FROM (
  SELECT category, split_part(path, '/', 2) IN (SELECT split_part(path, '/', 2) FROM man WHERE role = 'pool') AS x
  FROM man) GROUP BY 1""",
)
register(
    "D5_stratified_select",
    lambda s, d: D.stratified_select(
        td.table(s, d, "part").select(
            "p_partkey", F.when(F.col("p_size") > 3, F.col("p_type")).alias("category")
        ),
        SELECT, "p_partkey",
    ),
    with_(
        "items AS (SELECT p_partkey, coalesce(CASE WHEN p_size > 3 THEN p_type END, '') AS category FROM part)",
        "sizes AS (SELECT category, count(*) AS size, min(p_partkey) AS first FROM items GROUP BY 1)",
        f"al AS (SELECT * FROM {alloc_sql('sizes', str(SELECT), 'first')})",
    )
    + """SELECT p_partkey, category FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY p_partkey) AS rn
  FROM items JOIN al USING (category)) WHERE rn <= alloc""",
)
register(
    "D6_nested_subsets",
    lambda s, d: D.nested_subsets(parts(s, d), NESTED, "p_partkey"),
    with_(PARTS)
    + f"""SELECT p_partkey, category, ((rn > 25)::INT + (rn > 100)::INT + (rn > 150)::INT) AS slot FROM (
  SELECT *, row_number() OVER (ORDER BY {key_sql('subset', 'p_partkey')}, p_partkey) AS rn FROM items)""",
)

VAL = "CASE WHEN n >= 2 THEN greatest(1, round_even(n * 0.2::DOUBLE, 0)::BIGINT) ELSE 0 END"
register(
    "D7_split_identities",
    lambda s, d: D.split_identities(parts(s, d), "p_partkey", ["category"], "identity"),
    with_(PARTS)
    + f"""SELECT p_partkey, category, CASE WHEN rn <= {VAL} THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, count(*) OVER (PARTITION BY category) AS n,
         row_number() OVER (PARTITION BY category ORDER BY {key_sql('identity', 'p_partkey')}, p_partkey) AS rn
  FROM items)""",
)


def kinds(s, d) -> DataFrame:
    """(kind, category, name): objects from parts, occluders and backgrounds from documents."""
    man = td.manifest(s, d)
    one = lambda role, kind: man.filter(F.col("role") == role).select(
        F.lit(kind).alias("kind"), F.lit(kind).alias("category"), "path"
    ).withColumnRenamed("path", "name")
    return (
        td.table(s, d, "part").select(
            F.lit("object").alias("kind"), F.col("p_type").alias("category"),
            F.col("p_partkey").cast("string").alias("name"),
        )
        .unionByName(one("clutter", "occluder"))
        .unionByName(one("bg", "background"))
    )


KINDS = """kinds AS (
  SELECT 'object' AS kind, p_type AS category, p_partkey::VARCHAR AS name FROM part UNION ALL
  SELECT 'occluder', 'occluder', path FROM man WHERE role = 'clutter' UNION ALL
  SELECT 'background', 'background', path FROM man WHERE role = 'bg')"""
ASSIGNED = f"""assigned AS (
  SELECT kind, category, name, CASE WHEN rn <= {VAL} THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, count(*) OVER (PARTITION BY kind, category) AS n,
           row_number() OVER (PARTITION BY kind, category ORDER BY md5(concat_ws('|', '0', kind, name)), name) AS rn
    FROM kinds))"""
register(
    "D8_assign_kinds",
    lambda s, d: D.split_identities(kinds(s, d), "name", ["kind", "category"], F.col("kind")),
    with_(MANIFEST, KINDS, ASSIGNED) + "SELECT * FROM assigned",
)


def content_identities(s, d) -> DataFrame:
    """Documents assigned by id but identified by content, so repeated contents can clash."""
    rows = td.manifest(s, d).select(
        "doc_id", F.col("role").alias("kind"), Q.content_hash("content").alias("name")
    )
    return D.split_identities(rows, "doc_id", ["kind"], F.col("kind"))


register(
    "D9_identities_in_both",
    lambda s, d: D.identities_in_both(content_identities(s, d)),
    with_(
        MANIFEST,
        f"""a AS (SELECT role AS kind, md5(content) AS name, CASE WHEN rn <= {VAL} THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY role) AS n,
          row_number() OVER (PARTITION BY role ORDER BY md5(concat_ws('|', '0', role, doc_id)), doc_id) AS rn FROM man))""",
    )
    + "SELECT kind, name, count(DISTINCT split) AS n_splits FROM a GROUP BY ALL HAVING count(DISTINCT split) > 1",
)
register(
    "D10_positional_split",
    lambda s, d: D.positional_split(td.photo_roles(s, d), "image_id"),
    """SELECT image_id, role, CASE WHEN rn <= floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT o_orderkey AS image_id, CASE WHEN o_orderstatus = 'F' THEN 'pos_test' ELSE 'neg_test' END AS role,
         row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""",
)
register(
    "D11_role_sizes",
    lambda s, d: U.role_sizes(td.manifest(s, d), td.TRAIN_ROLES),
    with_(MANIFEST)
    + """SELECT role, category, CASE WHEN role IN ('pool', 'bg', 'clutter') THEN 'train' ELSE 'eval' END AS kind,
  count(*) AS n FROM man GROUP BY ALL""",
)

# ------------------------------------------------------------------ duplicates
ROLES_SQL = "roles AS (SELECT * FROM (VALUES (0, 'pool'), (1, 'bg'), (2, 'clutter'), (3, 'pos_test'), (4, 'neg_test')) t(i, role))"


def pair_sql(key: str) -> str:
    return f"""SELECT ra.role AS role_a, rb.role AS role_b, coalesce(n, 0) AS n_shared
FROM roles ra JOIN roles rb ON ra.i < rb.i LEFT JOIN (
  SELECT a.role AS x, b.role AS y, count(*) AS n
  FROM (SELECT DISTINCT role, {key} AS k FROM man) a JOIN (SELECT DISTINCT role, {key} AS k FROM man) b USING (k)
  GROUP BY ALL) ON x = ra.role AND y = rb.role"""


NORM = "lower(trim(translate(path, chr(92), '/')))"


def messy(s, d) -> DataFrame:
    """The manifest with paths written in different cases and separators, and re-used names."""
    flip = F.col("doc_id") % 3
    path = F.concat(F.lit("Shared/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".TXT"))
    path = F.when(flip == 0, F.translate(path, "/", "\\")).when(flip == 1, F.lower(path)).otherwise(
        F.concat(F.lit(" "), path)
    )
    return td.manifest(s, d).withColumn("path", path)


MESSY = f"""man AS (
  SELECT doc_id, role, category, content, CASE doc_id % 3
    WHEN 0 THEN 'Shared' || chr(92) || (doc_id // 2)::VARCHAR || '.TXT'
    WHEN 1 THEN 'shared/' || (doc_id // 2)::VARCHAR || '.txt'
    ELSE ' Shared/' || (doc_id // 2)::VARCHAR || '.TXT' END AS path
  FROM {{src}})"""
MESSY_MAN = MANIFEST.replace("man AS", "man0 AS") + ",\n" + MESSY.format(src="man0")

register(
    "Q1_duplicate_contents",
    lambda s, d: Q.duplicate_groups(td.manifest(s, d)),
    with_(MANIFEST)
    + """SELECT role, md5(content) AS content_hash, count(DISTINCT path) AS n_paths, min(path) AS first_path
FROM man GROUP BY 1, 2 HAVING count(DISTINCT path) > 1""",
)
register(
    "Q2_content_overlap",
    lambda s, d: U.content_overlap(td.manifest(s, d), td.MANIFEST_ROLES),
    with_(MANIFEST, ROLES_SQL) + pair_sql("md5(content)"),
)


def words(s, d) -> DataFrame:
    return td.fingerprints(s, d).select(
        "item_id", "role", *[F.element_at("hash", k).alias(f"w{k}") for k in range(1, 5)]
    )


register(
    "Q3_difference_hash",
    words,
    with_(HASHES)
    + "SELECT item_id, role, "
    + ", ".join(
        f"(CASE WHEN hw[{k}] >= 9223372036854775808::HUGEINT THEN hw[{k}] - 18446744073709551616::HUGEINT"
        f" ELSE hw[{k}] END)::BIGINT AS w{k}" for k in range(1, 5)
    )
    + " FROM fp",
)


def distinct_hashes(s, d) -> DataFrame:
    return td.fingerprints(s, d).groupBy("hash").agg(F.min("item_id").alias("item_id"))


register(
    "Q4_near_hashes",
    lambda s, d: Q.near_pairs(distinct_hashes(s, d), [], "item_id").withColumn("bits", F.col("bits").cast("bigint")),
    with_(HASHES, "u AS (SELECT hw, min(item_id) AS id FROM fp GROUP BY hw)")
    + f"SELECT a.id AS a, b.id AS b, {HAMMING}::BIGINT AS bits FROM u a JOIN u b ON a.id < b.id WHERE {HAMMING} <= 10",
)
NEAR = f"""near AS (
  SELECT ra.role AS role_a, rb.role AS role_b, coalesce(n, 0) AS n_pairs
  FROM roles ra JOIN roles rb ON ra.i <= rb.i LEFT JOIN (
    SELECT ia.role AS x, ib.role AS y, count(*) AS n FROM (
      SELECT a.role AS r1, b.role AS r2, ja.i AS i1, jb.i AS i2
      FROM fp a JOIN fp b ON a.item_id < b.item_id AND {HAMMING} <= 10
      JOIN roles ja ON ja.role = a.role JOIN roles jb ON jb.role = b.role)
    JOIN roles ia ON ia.i = least(i1, i2) JOIN roles ib ON ib.i = greatest(i1, i2) GROUP BY ALL)
  ON x = ra.role AND y = rb.role)"""


def near_table(s, d) -> DataFrame:
    return Q.near_duplicate_table(td.fingerprints(s, d), td.MANIFEST_ROLES)


register(
    "Q5_near_copies_within",
    lambda s, d: near_table(s, d).filter("role_a = role_b").select(F.col("role_a").alias("role"), "n_pairs"),
    with_(HASHES, ROLES_SQL, NEAR) + "SELECT role_a AS role, n_pairs FROM near WHERE role_a = role_b",
)
register(
    "Q6_near_copies_across",
    lambda s, d: near_table(s, d).filter("role_a <> role_b"),
    with_(HASHES, ROLES_SQL, NEAR) + "SELECT * FROM near WHERE role_a <> role_b",
)


def ordered_hashes(s, d) -> DataFrame:
    """Fingerprints in an order that mixes originals and copies."""
    o = F.conv(F.substring(keyed_hash(F.lit("walk"), "item_id"), 1, 12), 16, 10).cast("bigint")
    return td.fingerprints(s, d).withColumn("ord", o)


WALK_ORD = "('0x' || substr(md5(concat_ws('|', 'walk', item_id)), 1, 12))::BIGINT"
NEAR_LIST = " + ".join(f"bit_count(xor(k[{i}], n.hw[{i}]))::INT" for i in range(1, 5)) + " <= 10"


def walk_sql(src: str, part: str) -> str:
    """The sequential walk itself, one row per step, carrying the kept hashes."""
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ord) AS k FROM {src}),
walk AS (
  SELECT {part} AS grp, k, item_id, true AS keep, [hw] AS kept FROM seq WHERE k = 1
  UNION ALL
  SELECT w.grp, n.k, n.item_id, len(list_filter(w.kept, lambda k: {NEAR_LIST})) = 0,
         CASE WHEN len(list_filter(w.kept, lambda k: {NEAR_LIST})) = 0 THEN list_append(w.kept, n.hw) ELSE w.kept END
  FROM walk w JOIN seq n ON n.{part} = w.grp AND n.k = w.k + 1)"""


register(
    "Q7_drop_repeats",
    lambda s, d: Q.drop_repeats(ordered_hashes(s, d), ["role"]).select("role", "item_id"),
    "WITH RECURSIVE "
    + ",\n".join([HASHES, f"o AS (SELECT *, {WALK_ORD} AS ord FROM fp)", walk_sql("o", "role")])
    + "\nSELECT grp AS role, item_id FROM walk WHERE keep",
)


def across(s, d) -> DataFrame:
    rows = ordered_hashes(s, d)
    pool = rows.filter("role in ('pool', 'bg', 'clutter')").select("ord", "hash")
    return Q.drop_across(pool, rows.filter("role = 'pos_test'").select("ord", "hash"))


register(
    "Q8_drop_across",
    across,
    "WITH RECURSIVE "
    + ",\n".join(
        [
            HASHES, f"o AS (SELECT *, {WALK_ORD} AS ord, 0 AS one FROM fp)",
            "pool AS (SELECT * FROM o WHERE role IN ('pool', 'bg', 'clutter'))",
            "test AS (SELECT * FROM o WHERE role = 'pos_test')",
            f"hit AS (SELECT a.item_id, min(b.ord) AS match FROM pool a JOIN test b ON {HAMMING} <= 10 GROUP BY 1)",
            "rest AS (SELECT * FROM pool WHERE item_id NOT IN (SELECT item_id FROM hit))",
            walk_sql("rest", "one"),
            "kept AS (SELECT r.* FROM rest r JOIN walk w USING (item_id) WHERE keep)",
        ]
    )
    + f"""
SELECT ord, 'same as test' AS outcome, match FROM hit JOIN pool USING (item_id)
UNION ALL SELECT ord, 'kept', NULL FROM kept
UNION ALL SELECT a.ord, 'same as pool', min(b.ord) FROM rest a JOIN kept b ON {HAMMING} <= 10
WHERE a.item_id NOT IN (SELECT item_id FROM kept) GROUP BY a.ord""",
)
register(
    "Q9_path_overlap",
    lambda s, d: U.path_overlap(messy(s, d), td.MANIFEST_ROLES),
    with_(MESSY_MAN, ROLES_SQL) + pair_sql(NORM),
)


def path_masks(s, d):
    from ..functions.expressions import normalised_path

    return U.role_masks(messy(s, d), normalised_path("path"), td.MANIFEST_ROLES)


SPLIT_SETS = f"""tr AS (SELECT DISTINCT {NORM} AS p FROM man WHERE role IN ('pool', 'bg', 'clutter')),
te AS (SELECT DISTINCT {NORM} AS p FROM man WHERE role NOT IN ('pool', 'bg', 'clutter'))"""
register(
    "Q10_union_overlap",
    lambda s, d: U.union_overlap(path_masks(s, d), td.MANIFEST_ROLES, td.TRAIN_ROLES),
    with_(MESSY_MAN, SPLIT_SETS)
    + """SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM te) AS n_test,
  (SELECT count(*) FROM (SELECT p FROM tr INTERSECT SELECT p FROM te)) AS n_shared""",
)


def log(s, d) -> DataFrame:
    """An extraction log that consumed every labelled document, toxic ones from another folder."""
    labels = td.table(s, d, "labels").select("doc_id", "toxic")
    src = F.when(F.col("toxic") == 1, F.concat(F.lit("elsewhere/"), F.col("doc_id").cast("string")))
    return messy(s, d).join(labels, "doc_id").select(F.coalesce(src, "path").alias("source_path"))


LOG = f"""log AS (
  SELECT CASE WHEN toxic = 1 THEN 'elsewhere/' || doc_id::VARCHAR ELSE path END AS source_path
  FROM man JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id)),
used AS (SELECT DISTINCT {NORM.replace('path', 'source_path')} AS p FROM log)"""


def consumed(s, d) -> DataFrame:
    return U.consumed_paths(log(s, d), messy(s, d), td.TRAIN_ROLES)


register(
    "Q11_lineage_counts",
    lambda s, d: U.lineage_counts(consumed(s, d)),
    with_(MESSY_MAN, SPLIT_SETS, LOG)
    + """SELECT (SELECT count(*) FROM used) AS n_consumed,
  (SELECT count(*) FROM (SELECT p FROM used EXCEPT SELECT p FROM tr)) AS n_unauthorised,
  (SELECT count(*) FROM (SELECT p FROM used INTERSECT SELECT p FROM te)) AS n_leaked""",
)
register(
    "Q11_leaked_examples",
    lambda s, d: U.leaked_examples(consumed(s, d)),
    with_(MESSY_MAN, SPLIT_SETS, LOG)
    + "SELECT p AS path FROM (SELECT p FROM used INTERSECT SELECT p FROM te) ORDER BY p LIMIT 5",
)


def copies(s, d) -> DataFrame:
    """Background copies on disk: sides by hash, and a side holds each content once.

    The digest of a text stands for it, so that no text is shuffled.
    """
    bg = td.manifest(s, d).filter("role = 'bg'")
    side = F.when(hash32(F.lit("side"), F.col("doc_id")) % 2 < 1, "val").otherwise("train")
    return bg.select(side.alias("side"), F.md5("content").alias("content")).distinct()


COPIES = f"""copies AS (
  SELECT DISTINCT CASE WHEN {h('side', 'doc_id')} % 2 < 1 THEN 'val' ELSE 'train' END AS side, content
  FROM {{src}} WHERE role = 'bg'),
recon AS (
  SELECT n_disk, n_manifest, n_disk = n_manifest AS counts_match, n_shared FROM
    (SELECT count(*) AS n_disk FROM copies),
    (SELECT count(DISTINCT {NORM}) AS n_manifest FROM {{man}} WHERE role = 'bg'),
    (SELECT count(*) AS n_shared FROM (SELECT md5(content) FROM copies WHERE side = 'train'
       INTERSECT SELECT md5(content) FROM copies WHERE side = 'val')))"""
register(
    "Q12_reconcile_copies",
    lambda s, d: U.reconcile_copies(copies(s, d), td.manifest(s, d), "bg"),
    with_(MANIFEST, COPIES.format(src="man", man="man")) + "SELECT * FROM recon",
)


def report(s, d, with_copies: bool = False) -> DataFrame:
    return U.audit_report(
        messy(s, d), td.fingerprints(s, d), td.MANIFEST_ROLES, td.TRAIN_ROLES, log(s, d),
        copies(s, d) if with_copies else None,
    )


def status(sql: str) -> str:
    return f"SELECT *, CASE WHEN n = 0 THEN 'ok' ELSE 'FAIL' END AS status FROM ({sql})"


def report_sql(with_copies: bool) -> str:
    parts = [
        f"SELECT '1 paths by pair' AS check, role_a AS a, role_b AS b, n_shared AS n FROM ({pair_sql(NORM)})",
        "SELECT '2 train and eval unions', '', '', (SELECT count(*) FROM (SELECT p FROM tr INTERSECT SELECT p FROM te))",
        "SELECT '3 lineage', 'unauthorised', '', (SELECT count(*) FROM (SELECT p FROM used EXCEPT SELECT p FROM tr))",
        "SELECT '3 lineage', 'leaked', '', (SELECT count(*) FROM (SELECT p FROM used INTERSECT SELECT p FROM te))",
        f"""SELECT '5 content within', role, '', (SELECT count(*) FROM (SELECT 1 FROM man m WHERE m.role = roles.role
          GROUP BY md5(content) HAVING count(DISTINCT path) > 1)) FROM roles""",
        f"SELECT '5 content by pair', role_a, role_b, n_shared FROM ({pair_sql('md5(content)')})",
        "SELECT '6 near copies within', role_a, '', n_pairs FROM near WHERE role_a = role_b",
        "SELECT '6 near copies by pair', role_a, role_b, n_pairs FROM near WHERE role_a <> role_b",
    ]
    if with_copies:
        parts += [
            "SELECT '4 copies', 'count difference', '', abs(n_disk - n_manifest) FROM recon",
            "SELECT '4 copies', 'train and val', '', n_shared FROM recon",
        ]
    body = status(" UNION ALL ".join(parts))
    if not with_copies:
        body += " UNION ALL SELECT '4 copies', '', '', NULL, 'skipped'"
    ctes = [MESSY_MAN, ROLES_SQL, SPLIT_SETS, LOG, HASHES, NEAR]
    if with_copies:
        ctes.append(COPIES.format(src="man0", man="man"))
    return with_(*ctes, f"rep AS ({body})")


register("Q13_audit_report", lambda s, d: report(s, d, True), report_sql(True) + "SELECT * FROM rep")
register(
    "Q13_audit_verdict",
    lambda s, d: U.audit_verdict(report(s, d)),
    report_sql(False)
    + """SELECT count(*) FILTER (status = 'FAIL') AS n_failed, count(*) FILTER (status = 'ok') AS n_passed,
  count(*) FILTER (status = 'skipped') AS n_skipped,
  CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict FROM rep""",
)
