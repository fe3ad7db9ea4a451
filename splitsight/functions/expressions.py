"""Column expressions shared by the operators. Everything here stays on the JVM."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ hashing
def keyed_hash(*parts) -> Column:
    """md5 of the parts joined by '|'. Strings are column names; use lit() for constants."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def hash32(*parts) -> Column:
    """The first 32 bits of keyed_hash as a non-negative bigint."""
    return F.conv(F.substring(keyed_hash(*parts), 1, 8), 16, 10).cast("bigint")


def hash60(*parts) -> Column:
    """The first 60 bits of keyed_hash: wide enough to index tables beyond 2^32 rows."""
    return F.conv(F.substring(keyed_hash(*parts), 1, 15), 16, 10).cast("bigint")


# ------------------------------------------------------------------ numbers
def round_to(x, digits: int) -> Column:
    """Round a double to `digits` decimals, ties to even."""
    scale = float(10**digits)
    return F.rint(_col(x) * F.lit(scale)) / F.lit(scale)


def ratio(num, den, default: float = 0.0) -> Column:
    """num / den as double, `default` when den is zero."""
    num, den = _col(num), _col(den)
    return F.when(den == 0, F.lit(default)).otherwise(num.cast("double") / den.cast("double"))


def ln_gamma(x) -> Column:
    """Natural log of the gamma function for x > 0 (Stirling's series after a shift of 10)."""
    x = _col(x).cast("double")
    y = x + F.lit(10.0)
    shift = x
    for i in range(1, 10):
        shift = shift * (x + F.lit(float(i)))
    y2 = y * y
    series = F.lit(1.0) / (12 * y) * (
        1 - (F.lit(1.0) / (30 * y2)) * (1 - (F.lit(2.0) / (7 * y2)) * (1 - F.lit(3.0) / (4 * y2)))
    )
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * log(2 * pi)) + series - F.log(shift)


# ------------------------------------------------------------------ intervals and tests
def wilson(k, n, z: float = 1.96, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n. Clamped form gives (0, 0) when n is 0."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    p = k / n
    zz = F.lit(z) * F.lit(z)
    d = 1 + zz / n
    centre = (p + zz / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    lo, hi = centre - half, centre + half
    if not clamp:
        return lo, hi
    zero = F.lit(0.0)
    return (
        F.when(n == 0, zero).otherwise(F.greatest(zero, lo)),
        F.when(n == 0, zero).otherwise(F.least(F.lit(1.0), hi)),
    )


def _stirling_rest(x: Column) -> Column:
    """ln x! less Stirling's main part, for whole x > 0; the series needs a large x, small ones shift up."""
    y = x + 16.0
    inv = 1.0 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / y
    small = F.lit(0.0)
    for i in range(1, 17):
        small = small + F.log(x + float(i))
    # ln x! = ln (x + 16)! - sum of ln(x + i); both main parts cancel but for this.
    shifted = series + (y + 0.5) * F.log(y) - y - small - ((x + 0.5) * F.log(x) - x)
    direct = 1.0 / (x * x)
    large = (1 / 12 - direct * (1 / 360 - direct * (1 / 1260 - direct / 1680))) / x
    return F.when(x < 16, shifted).otherwise(large)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x without cancellation near x = mean."""
    v = (x - mean) / (x + mean)
    series = F.lit(0.0)
    for j in range(9, 0, -1):
        series = (series + 1.0 / (2 * j + 1)) * v * v
    near = (x - mean) * v + 2 * x * v * series
    return F.when(F.abs(v) < 0.1, near).otherwise(x * F.log(x / mean) + mean - x)


def mcnemar_exact(b, c) -> Column:
    """Two-sided exact binomial p-value of b against c discordant pairs, 1 when there are none.

    The largest term of the lower tail comes from its saddle-point form, whose parts do not cancel for
    counts in the billions; the tail is then summed downwards by ratios. Terms further than
    5 * sqrt(n) + 40 below it are under 1e-20 of the first, so leaving them out cannot change a
    double; this keeps the work at sqrt(n).
    """
    b, c = _col(b).cast("bigint"), _col(c).cast("bigint")
    n = b + c
    k = F.least(b, c)
    nd = n.cast("double")
    kd = k.cast("double")
    rest, half = nd - kd, nd / 2
    at_peak = F.exp(
        _stirling_rest(nd) - _stirling_rest(kd) - _stirling_rest(rest) - _deviance(kd, half) - _deviance(rest, half)
    ) * F.sqrt(nd / (2 * pi * kd * rest))
    top = F.when(k == 0, F.pow(F.lit(0.5), nd)).otherwise(at_peak)
    steps = F.least(k, (F.sqrt(nd) * 5).cast("bigint") + 40)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, j):
        term = acc["term"] * (kd - j.cast("double") + 1) / (nd - kd + j.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    walk = F.when(steps >= 1, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(
        F.array().cast("array<bigint>")
    )
    total = F.aggregate(walk, start, add, lambda acc: acc["total"])
    p = F.least(F.lit(1.0), F.lit(2.0) * top * total)
    return F.when(n == 0, F.lit(1.0)).otherwise(p)


def paired_difference(gain, loss, n, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(difference, low, high): Wald interval for paired proportions, variance floored at 0."""
    gain, loss, n = (_col(x).cast("double") for x in (gain, loss, n))
    d = (gain - loss) / n
    se = F.sqrt(F.greatest(gain + loss - (gain - loss) * (gain - loss) / n, F.lit(0.0))) / n
    return d, d - F.lit(z) * se, d + F.lit(z) * se


def stars(p) -> Column:
    """'***' under 0.001, '**' under 0.01, '*' under 0.05, else 'n.s.'."""
    p = _col(p)
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")
    )


def fixed(x, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", round_to(x, digits))


# ------------------------------------------------------------------ boxes
def iou(a: tuple, b: tuple) -> Column:
    """IoU of two boxes given as (x0, y0, x1, y1) columns; 0 without overlap or area."""
    ax0, ay0, ax1, ay1 = (_col(c).cast("double") for c in a)
    bx0, by0, bx1, by1 = (_col(c).cast("double") for c in b)
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(
        zero, F.least(ay1, by1) - F.greatest(ay0, by0)
    )
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter
    return F.when((inter <= 0) | (union <= 0), zero).otherwise(inter / union)


def label_line(x0, y0, x1, y1, size: int = 640) -> Column:
    """Ground-truth text line '0 cx cy w h', normalised, six decimals."""
    x0, y0, x1, y1 = (_col(c).cast("double") for c in (x0, y0, x1, y1))
    s = F.lit(float(size))
    parts = ((x0 + x1) / 2 / s, (y0 + y1) / 2 / s, (x1 - x0) / s, (y1 - y0) / s)
    return F.concat_ws(" ", F.lit("0"), *[fixed(p, 6) for p in parts])


# ------------------------------------------------------------------ paths and names
def normalised_path(path) -> Column:
    """Separator- and case-insensitive form of a path."""
    return F.lower(F.trim(F.translate(_col(path), "\\", "/")))


def base_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_name(path) -> Column:
    """Name of the directory that holds the file."""
    return F.element_at(F.split(_col(path), "/"), -2)


def stem(name) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(_col(name), r"(?<=.)\.[^.]*$", "")


def name_category(file_name) -> Column:
    """Category carried by a file name: the stem less a trailing all-digit token.

    The token is split off at the last space; only when that leaves no all-digit token, at the
    last underscore. Underscores then become spaces.
    """
    s = stem(file_name)
    cut = (
        F.when(s.rlike(r" \d+$"), F.regexp_replace(s, r" \d+$", ""))
        .when(s.rlike(r"_\d+$"), F.regexp_replace(s, r"_\d+$", ""))
        .otherwise(s)
    )
    return F.trim(F.translate(cut, "_", " "))


def run_name(pool, tag, seed) -> Column:
    """pool<N>[_tag][_s<seed>]; an empty tag and seed 0 add nothing."""
    pool, tag, seed = _col(pool), _col(tag), _col(seed)
    return F.concat(
        F.lit("pool"),
        pool.cast("string"),
        F.when(F.coalesce(tag, F.lit("")) != "", F.concat(F.lit("_"), tag)).otherwise(""),
        F.when(seed != 0, F.concat(F.lit("_s"), seed.cast("string"))).otherwise(""),
    )


# ------------------------------------------------------------------ perceptual hashes
HASH_WORDS = 4
HASH_SIDE = 16
NEAR_DUPLICATE_BITS = 10


def difference_hash(grid) -> Column:
    """256 difference bits of a 16 x 17 grid (array of rows) as four 64-bit words.

    A bit says whether an element is greater than its right neighbour, row-major, first bit
    highest.
    """
    grid = _col(grid)

    def row_bits(row):
        bits = F.zip_with(
            F.slice(row, 1, HASH_SIDE), F.slice(row, 2, HASH_SIDE), lambda a, b: (a > b)
        )
        return F.aggregate(
            bits,
            F.lit(0).cast("bigint"),
            lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("bigint")),
        )

    rows = F.transform(grid, row_bits)
    per_word = HASH_SIDE // HASH_WORDS

    def word(k):
        return F.aggregate(
            F.slice(rows, k * per_word + 1, per_word),
            F.lit(0).cast("bigint"),
            lambda acc, r: F.shiftleft(acc, HASH_SIDE).bitwiseOR(r),
        )

    return F.array(*[word(k) for k in range(HASH_WORDS)])


def hamming(a, b) -> Column:
    """Number of differing bits between two hash word arrays."""
    a, b = _col(a), _col(b)
    total = F.lit(0)
    for k in range(1, HASH_WORDS + 1):
        total = total + F.bit_count(F.element_at(a, k).bitwiseXOR(F.element_at(b, k)))
    return total


def same_image(a, b) -> Column:
    return hamming(a, b) <= NEAR_DUPLICATE_BITS
