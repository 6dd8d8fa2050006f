"""Whitening of embeddings through an exact characteristic polynomial (operator 12).

Entries c become integers x = floor(256 * c).  The fit list holds each distinct x vector once: n vectors,
sums S, and the integer scatter M = n * sum(x x') - S S', which is n^2 times their covariance.

1. Sums of products are exact: x is cut into limbs of ``LIMB`` bits, products of limbs are added by float
   matrix products that stay below 2^53, and Spark adds the tasks' totals as decimals.
2. M's characteristic polynomial is computed modulo enough 31-bit primes, one Spark row per prime: M is
   brought to Hessenberg form, whose polynomial follows from a recurrence.  The Chinese remainder theorem
   gives the integer coefficients; the eigenvalues' mean bounds them, so the primes are known beforehand.
3. All roots are real, so by Descartes' rule the sign changes of p(y + a) count exactly the roots above a,
   with their multiplicity.  Bisection on these counts isolates the largest roots to ``ROOT_BITS`` bits.
4. A component spans the null space of M - e I: inverse iteration in integers of ``ROOT_BITS`` * 2 + 200
   bits after the point, in a block where several eigenvalues share an interval.

What reaches the driver depends on the dimension d alone: d^2 sums and about d / 2 residue rows of d
numbers for every 16 bits of M.  The result is checked by measuring the covariance of the whitened vectors
over the fit list.

Result per row and component: n, deviation (sum of (n x - S)^2), whitened, explained, identity_error.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; vectors shorter than
the longest one count as followed by zeros; entries beyond a long are held at its ends; repeated rows
repeat their result and count once in the fit; a null vec_id is kept; components without variance are left
out (so a single distinct vector, or empty vectors, give no rows); a deviation beyond a long is null;
no usable row gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import on_workers, stage

SCALE = 256
COMPONENTS = 4
LIMB = 20
ROWS = 4096  # rows of one matrix product: 2^12 * 2^20 * 2^20 stays exact in a double
ROOT_BITS = 110  # relative precision of an isolated root
STEPS = 3  # of inverse iteration
PRIMES_BELOW = 1 << 31

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


# ---------------------------------------------------------------------------
# Integer vectors and their scatter
# ---------------------------------------------------------------------------


def finite(vector: Column) -> Column:
    """The vector is there and all its entries are finite numbers."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def integers(vector: Column, width: int) -> Column:
    """floor(256 * c) of all entries as longs, filled up with zeros."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb k times 2^(LIMB k), each of at most LIMB bits and a sign, as doubles."""
    out = []
    while True:
        if not x.size or np.abs(np.clip(x, -(1 << 62), 1 << 62)).max() < 1 << LIMB:
            return [*out, x.astype(np.float64)]
        low = x & ((1 << LIMB) - 1)
        out.append(low.astype(np.float64))
        x = x >> LIMB


def scatter_parts(fit: DataFrame, width: int) -> DataFrame:
    """(power, i, j, total): sums of z_i z_j over z = (1, x), in units of 2^(LIMB power); i <= j."""
    at = np.triu_indices(width + 1)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        held = 0

        def flush():
            for power, total in sums.items():
                values = total[at]
                some = np.flatnonzero(values)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(some), power, np.int32)), pa.array(at[0][some].astype(np.int32)),
                        pa.array(at[1][some].astype(np.int32)), pa.array(values[some]),
                    ],
                    names=["power", "i", "j", "total"],
                )
            sums.clear()

        for batch in batches:
            x = matrix(batch.column(0), width)
            for low in range(0, len(x), ROWS):
                z = np.column_stack([np.ones(len(x[low : low + ROWS]), np.int64), x[low : low + ROWS]])
                cut = limbs(z)
                for a, left in enumerate(cut):
                    for b, right in enumerate(cut):
                        product = (left.T @ right).astype(np.int64)
                        sums[a + b] = sums[a + b] + product if a + b in sums else product
                held += 1
                if held % 256 == 0:  # 2^8 times at most 4 products of 2^53 stay in a long
                    yield from flush()
        yield from flush()

    parts = on_workers(fit).select("x").mapInArrow(run, "power int, i int, j int, total long")
    return parts.groupBy("power", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def scatter(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of the fit list, as exact integers."""
    g = [[0] * (width + 1) for _ in range(width + 1)]
    for r in scatter_parts(fit, width).collect():  # at most (d + 1)^2 rows per power of a limb
        g[r.i][r.j] += int(r.total) << (LIMB * r.power)
    n, s = g[0][0], g[0][1:]
    m = [[0] * width for _ in range(width)]
    for i in range(width):
        for j in range(i, width):
            m[i][j] = m[j][i] = n * g[i + 1][j + 1] - s[i] * s[j]
    return n, s, m


# ---------------------------------------------------------------------------
# The characteristic polynomial
# ---------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2^32."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        if base % n == 0:
            continue
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes under 2^31 whose product exceeds ``bound``."""
    out, product, n = [], 1, PRIMES_BELOW - 1
    while product <= bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def coefficient_bound(trace: int, d: int) -> int:
    """No coefficient exceeds C(d, k) (trace / k)^k for some k: the roots are not negative and add up to the trace."""
    return max([1, *(math.comb(d, k) * (trace // k + 1) ** k for k in range(1, d + 1))])


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p of det(y I - m), from the constant one up, by Hessenberg reduction."""
    h, d = m % p, len(m)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        pivot = j + 1 + int(below[0])
        if pivot != j + 1:
            h[[j + 1, pivot]] = h[[pivot, j + 1]]
            h[:, [j + 1, pivot]] = h[:, [pivot, j + 1]]
        factor = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - factor[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * factor % p).sum(axis=1)) % p
    # leading blocks' polynomials: q_k = (y - h_kk) q_(k-1) - sum over i < k of h_ik (product of subdiagonals) q_(i-1)
    q = np.zeros((d + 1, d + 1), np.int64)
    q[0, 0] = 1
    for k in range(d):
        q[k + 1, 1:] = q[k, :-1]
        along, weights = 1, np.zeros(k + 1, np.int64)
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * along % p
            along = along * int(h[i, i - 1]) % p if i else 0
        q[k + 1] = (q[k + 1] - (weights[:, None] * q[: k + 1] % p).sum(axis=0)) % p
    return q[d]


def characteristic(fit: DataFrame, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(y I - m), from the constant one up; residues are computed by Spark tasks."""
    spark, d = fit.sparkSession, len(m)
    primes = primes_for(2 * coefficient_bound(sum(m[i][i] for i in range(d)), d))
    sent = spark.sparkContext.broadcast((primes, m))

    def run(batches):
        for batch in batches:
            named, whole = sent.value
            found = [named[k] for k in batch.column(0).to_pylist()]
            rows = [polynomial_mod(np.array([[x % p for x in row] for row in whole], np.int64), p).tolist() for p in found]
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["prime", "residues"])

    tasks = min(len(primes), 2 * spark.sparkContext.defaultParallelism)
    found = on_workers(spark.range(0, len(primes), 1, tasks)).mapInArrow(run, "prime long, residues array<long>").collect()
    return remaindered([(r.prime, r.residues) for r in found])


def remaindered(found: list[tuple[int, list[int]]]) -> list[int]:
    """Signed integers from their residues (Chinese remainder theorem)."""
    whole = math.prod(p for p, _ in found)
    shares = [(whole // p) * pow(whole // p % p, -1, p) for p, _ in found]
    out = []
    for k in range(len(found[0][1])):
        x = sum(share * residues[k] for share, (_, residues) in zip(shares, found, strict=True)) % whole
        out.append(x - whole if 2 * x > whole else x)
    return out


# ---------------------------------------------------------------------------
# Roots and null spaces
# ---------------------------------------------------------------------------


class Roots:
    """Counts of the roots above a = place / 2^scale; the polynomial has real roots only."""

    def __init__(self, coefficients: list[int]) -> None:
        self.coefficients = coefficients
        self.known: dict[tuple[int, int], int] = {}

    def above(self, place: int, scale: int) -> int:
        key = (place, scale)
        if key not in self.known:
            d = len(self.coefficients) - 1
            c = [x << (scale * (d - k)) for k, x in enumerate(self.coefficients)]
            for low in range(d):  # Taylor shift by repeated synthetic division
                for k in range(d - 1, low - 1, -1):
                    c[k] += place * c[k + 1]
            signs = [x > 0 for x in c if x]
            self.known[key] = sum(x != y for x, y in zip(signs, signs[1:], strict=False))
        return self.known[key]

    def isolate(self, wanted: int, top: int) -> tuple[int, int]:
        """(place, scale): the ``wanted``-th largest root lies above place / 2^scale and not above (place + 1) / 2^scale."""
        low, high, scale = 0, top + 1, 0
        while high - low > 1:
            middle = (low + high) // 2
            if self.above(middle, 0) >= wanted:
                low = middle
            else:
                high = middle
        while low.bit_length() < ROOT_BITS:
            low, scale = 2 * low, scale + 1
            if self.above(low + 1, scale) >= wanted:
                low += 1
        return low, scale


def null_space(m: list[list[int]], place: int, scale: int, count: int) -> list[list[int]]:
    """``count`` orthonormal vectors (in units of 2^-bits) of the eigenvalues within (place, place + 1] / 2^scale."""
    d, bits = len(m), 2 * ROOT_BITS + 200
    size = max(1, max(m[i][i] for i in range(d)).bit_length()) + scale + 1
    middle = 2 * place + 1  # in units of 2^-(scale + 1)
    a = np.empty((d, d), object)
    for i in range(d):
        for j in range(d):
            x = (m[i][j] << (scale + 1)) - (middle if i == j else 0)
            a[i, j] = x << (bits - size) if bits >= size else x >> (size - bits)
    # factors once, with row exchanges; a pivot of zero becomes the smallest number there is
    order, lower = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            lower[[k, best]] = lower[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            factor = (a[k + 1 :, k] << bits) // a[k, k]
            lower[k + 1 :, k] = factor
            a[k + 1 :, k:] -= (factor[:, None] * a[k, k:][None, :]) >> bits

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(d - 1):
            y[k + 1 :] -= (lower[k + 1 :, k] * y[k]) >> bits
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << bits) // a[k, k]
            y[:k] -= (a[:k, k] * y[k]) >> bits
        return y

    def orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
        done: list[np.ndarray] = []
        for v in vectors:
            v = (v << bits) // max(1, math.isqrt(int((v * v).sum())))
            for _ in range(2):
                for u in done:
                    v = v - ((u * (int((u * v).sum()) >> bits)) >> bits)
                v = (v << bits) // max(1, math.isqrt(int((v * v).sum())))
            done.append(v)
        return done

    seed = random.Random(12)
    vectors = [np.array([seed.getrandbits(64) + 1 << (bits - 64) for _ in range(d)], object) for _ in range(count)]
    for _ in range(STEPS):
        vectors = orthonormal([solve(v) for v in orthonormal(vectors)])
    return [v.tolist() for v in vectors]


def components(m: list[list[int]], coefficients: list[int], most: int) -> list[tuple[float, float, list[float]]]:
    """(root, share of the trace, unit vector) of the ``most`` largest positive roots, largest first."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    roots, out = Roots(coefficients), []
    positive = roots.above(0, 0) if trace else 0
    while len(out) < min(most, positive):
        place, scale = roots.isolate(len(out) + 1, trace)
        held = roots.above(place, scale) - roots.above(place + 1, scale)
        together = null_space(m, place, scale, held)
        for v in together[: most - len(out)]:
            largest = max(range(d), key=lambda i: abs(v[i]))
            sign, length = (1 if v[largest] > 0 else -1), math.isqrt(sum(x * x for x in v))
            root = (2 * place + 1) / (1 << (scale + 1))
            out.append((root, (2 * place + 1) / (trace << (scale + 1)), [sign * x / length for x in v]))
    return out


# ---------------------------------------------------------------------------
# Whitening
# ---------------------------------------------------------------------------


class Whitener:
    """n, S and the components; turns integer vectors into deviations and whitened values."""

    def __init__(self, n: int, s: list[int], largest: int, found: list[tuple[float, float, list[float]]]) -> None:
        self.n, self.s = n, s
        self.plain = 2 * n * (largest + 1) < 1 << 62
        self.squares = len(s) * (2 * n * (largest + 1)) ** 2 < 1 << 62
        self.turn = np.array([[x / math.sqrt(root) for x in v] for root, _, v in found], np.float64).T.reshape(len(s), len(found))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.plain:
            return x * np.int64(self.n) - np.array(self.s, np.int64)
        return x.astype(object) * self.n - np.array(self.s, object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        exact = centred if self.squares else centred.astype(object)
        total = [int(v) for v in (exact * exact).sum(axis=1)]
        return [v if v < 1 << 63 else None for v in total]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.turn


def identity_error(fit: DataFrame, model, width: int, count: int) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|, centred in each task, then together."""
    names = [f"m{i}" for i in range(count)] + [f"c{i}_{j}" for i in range(count) for j in range(i, count)]

    def run(batches):
        n, mean, spread = 0, np.zeros(count), np.zeros((count, count))
        for batch in batches:
            own = model.value
            w = own.whitened(own.centred(matrix(batch.column(0), width)))
            if not len(w):
                continue
            here = w.mean(axis=0)
            apart, both = here - mean, n + len(w)
            spread += (w - here).T @ (w - here) + np.outer(apart, apart) * (n * len(w) / both)
            mean = mean + apart * (len(w) / both)
            n = both
        values = [*mean, *(spread[i, j] for i in range(count) for j in range(i, count))]
        yield pa.record_batch([pa.array([n]), *[pa.array([float(v)]) for v in values]], names=["n", *names])

    schema = "n long, " + ", ".join(f"{c} double" for c in names)
    parts = stage(on_workers(fit).select("x").mapInArrow(run, schema).where("n > 0"), "whitened-moments")
    whole = parts.agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(count)]).first()
    off = lambda i: F.col(f"m{i}") - F.lit(whole[f"m{i}"])
    spread = parts.agg(
        *[F.sum(F.col(f"c{i}_{j}") + F.col("n") * off(i) * off(j)).alias(f"c{i}_{j}") for i in range(count) for j in range(i, count)]
    ).first()
    return max(abs(spread[f"c{i}_{j}"] / whole.n - (i == j)) for i in range(count) for j in range(i, count))


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.  ``table``: vec_id, embedding."""
    spark = table.sparkSession
    nothing = spark.createDataFrame([], SCHEMA + ", identity_error double")
    usable = table.where(finite(F.col("embedding"))).select("vec_id", "embedding")
    width = usable.agg(F.max(F.size("embedding"))).first()[0]
    if not width:
        return nothing
    whole = usable.select("vec_id", integers(F.col("embedding"), width).alias("x"))
    fit = stage(whole.select("x").distinct(), "fit-list")
    n, s, m = scatter(fit, width)
    found = components(m, characteristic(fit, m), most)
    if not found:
        return nothing
    # n sum(x_i^2) = m_ii + s_i^2 bounds every entry
    largest = math.isqrt(max((m[i][i] + s[i] * s[i]) // n for i in range(width)))
    model = spark.sparkContext.broadcast(Whitener(n, s, largest, found))
    shares = np.array([share for _, share, _ in found])
    error = identity_error(fit, model, width, len(found))
    count = len(found)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                some = batch.slice(low, ROWS)
                own = model.value
                centred = own.centred(matrix(some.column(1), width))
                rows = some.num_rows
                each = pa.array(np.repeat(np.arange(rows), count))
                yield pa.record_batch(
                    [
                        some.column(0).cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * count, n)), pa.array(own.deviations(centred), pa.int64()).take(each),
                        pa.array(own.whitened(centred).ravel()), pa.array(np.tile(shares, rows)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return on_workers(whole).mapInArrow(run, SCHEMA).withColumn("identity_error", F.lit(error))
