"""The adapters of `splitsight.sources.testdata` as SQL common table expressions."""

from __future__ import annotations

LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def h(tag: str, cols: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{tag}', {cols})), 1, 8))::BIGINT)"


def unit(tag: str, cols: str) -> str:
    return f"({h(tag, cols)}::DOUBLE / 4294967296.0::DOUBLE)"


def rnd(x: str, digits: int) -> str:
    """Ties-to-even rounding of a double, as `round_to`."""
    s = f"{10**digits}.0::DOUBLE"
    return f"(round_even(({x}) * {s}, 0) / {s})"


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"(({k})::DOUBLE / ({n})::DOUBLE)"
    n = f"(({n})::DOUBLE)"
    z = "(1.96::DOUBLE)"
    d = f"(1 + {z}*{z}/{n})"
    c = f"(({p} + {z}*{z}/(2*{n})) / {d})"
    hw = f"({z} * sqrt({p}*(1-{p})/{n} + {z}*{z}/(4*{n}*{n})) / {d})"
    return f"({c} - {hw})", f"({c} + {hw})"


def mcnemar(b: str, c: str) -> str:
    n, k = f"({b} + {c})", f"least({b}, {c})"
    return (
        f"CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0::DOUBLE * list_sum("
        f"list_transform(range(0, {k} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1)"
        f" - lgamma({n} - i + 1) - {n} * ln(2.0::DOUBLE))))) END"
    )


PHOTO = """photo AS (
  SELECT o_orderkey AS image_id,
         CASE WHEN o_orderstatus = 'F' THEN 'pos_test' ELSE 'neg_test' END AS role,
         c_mktsegment AS category
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

BOX = f"""rawbox AS (
  SELECT l_orderkey AS image_id, 'm' || (l_suppkey % 4)::VARCHAR AS arm,
         concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS box_id,
         {unit('conf', LINE_KEY)} AS u,
         {h('cx', 'l_orderkey')} % 400 + {h('jx', LINE_KEY)} % 30 AS x0,
         {h('cy', 'l_orderkey')} % 400 + {h('jy', LINE_KEY)} % 30 AS y0,
         100 + {h('w', LINE_KEY)} % 20 AS w, 100 + {h('h', LINE_KEY)} % 20 AS h
  FROM lineitem),
box AS (
  SELECT image_id, arm, CASE WHEN o_orderstatus = 'F' THEN 'pos_test' ELSE 'neg_test' END AS role,
         box_id,
         CASE WHEN o_orderstatus = 'F' THEN 1 - (1 - u) * (1 - u) ELSE u * u END AS conf,
         x0, y0, x0 + w AS x1, y0 + h AS y1
  FROM rawbox JOIN orders ON image_id = o_orderkey)"""

ARM = "arms AS (SELECT 'm' || i::VARCHAR AS arm, i AS ord FROM range(0, 4) t(i))"

IMAGES = f"""{PHOTO}, {BOX}, {ARM},
rawimg AS (
  SELECT arm, image_id, count(*) AS n_boxes, max(conf) AS top FROM box GROUP BY ALL),
img AS (
  SELECT a.arm, p.image_id, p.role, p.category, coalesce(r.n_boxes, 0) AS n_boxes,
         r.top, {rnd('r.top', 6)} AS max_conf
  FROM photo p CROSS JOIN arms a
  LEFT JOIN rawimg r ON r.arm = a.arm AND r.image_id = p.image_id)"""

TRUTH = f"""truth AS (
  SELECT o_orderkey AS image_id, 0 AS truth_id,
         {h('cx', 'o_orderkey')} % 400 AS x0, {h('cy', 'o_orderkey')} % 400 AS y0,
         {h('cx', 'o_orderkey')} % 400 + 100 AS x1, {h('cy', 'o_orderkey')} % 400 + 100 AS y1
  FROM orders WHERE o_orderstatus = 'F')"""

ROLE_CASE = """CASE WHEN k < 2 THEN 'pool' WHEN k < 4 THEN 'bg' WHEN k < 6 THEN 'clutter'
  WHEN k < 12 THEN 'pos_test' ELSE 'neg_test' END"""

MANIFEST = f"""man AS (
  SELECT doc_id, {ROLE_CASE} AS role, lang AS category,
         source || '/' || lang || '_' || doc_id::VARCHAR || '.txt' AS path, text AS content
  FROM (SELECT *, {h('role', 'doc_id')} % 20 AS k FROM documents))"""

HASHES = f"""bits AS (
  SELECT vec_id, list_transform(range(0, 4), lambda w: list_reduce(list_transform(range(0, 64),
           lambda b: CASE WHEN embedding[((2*(w*4 + b//16) + 1) * (b % 16)) % 64 + 1]
                             > embedding[((2*(w*4 + b//16) + 1) * (b % 16 + 1)) % 64 + 1]
                     THEN 1::HUGEINT ELSE 0::HUGEINT END),
           lambda acc, x: acc * 2 + x)) AS hw
  FROM embeddings),
fp0 AS (
  SELECT 2 * vec_id AS item_id, hw FROM bits UNION ALL
  SELECT 2 * vec_id + 1, [hw[1], hw[2], hw[3],
         xor(hw[4], (1::HUGEINT << (vec_id % 13)::INT) - 1)] FROM bits),
fp AS (
  SELECT item_id, {ROLE_CASE} AS role, hw
  FROM (SELECT *, {h('role', 'item_id')} % 20 AS k FROM fp0))"""

HAMMING = (
    "(bit_count(xor(a.hw[1], b.hw[1]))::INT + bit_count(xor(a.hw[2], b.hw[2]))::INT"
    " + bit_count(xor(a.hw[3], b.hw[3]))::INT + bit_count(xor(a.hw[4], b.hw[4]))::INT)"
)

SIGNED = (
    "list_transform(hw, lambda x: (CASE WHEN x >= 9223372036854775808::HUGEINT"
    " THEN x - 18446744073709551616::HUGEINT ELSE x END)::BIGINT)"
)

ROUNDS = """rnds AS (
  SELECT event_type AS arm, ts::DATE AS round,
         sum(round(value * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 100 AS ms
  FROM events GROUP BY ALL)"""

CURVE = """curve AS (
  SELECT event_type AS arm, day(ts)::INT AS epoch,
         sum(round(value * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 100 AS metric
  FROM events GROUP BY ALL)"""

SCREEN = f"""item AS (
  SELECT p_partkey AS item, p_type AS category, {unit('solid', 'p_partkey')} AS solid,
         {unit('haze', 'p_partkey')} AS haze FROM part),
ibox AS (
  SELECT l_partkey AS item, concat_ws('-', l_orderkey, l_suppkey, l_linenumber) AS seq,
         l_returnflag || l_linestatus AS cls, {unit('conf', LINE_KEY)} AS conf,
         l_quantity AS area
  FROM lineitem)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
