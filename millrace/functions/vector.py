"""Block quantisation and other array arithmetic as native column expressions over array<double>."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import bind
from millrace.functions.hashing import u01

# Fixed values of the formats.
E4M3_MAX, E5M2_MAX, BLOCK = 448.0, 57344.0, 32
TINY = 1e-12


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def amax(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def absmax_scale(x: Column, bits: int = 8) -> Column:
    return F.greatest(amax(x) / F.lit(float(2 ** (bits - 1) - 1)), F.lit(1e-8))


def absmax_quantize(x: Column, bits: int = 8) -> Column:
    """Whole numbers of +-(2^(bits-1)-1), halves to even."""
    top = float(2 ** (bits - 1) - 1)
    return bind(absmax_scale(x, bits), lambda scale: F.transform(x, lambda v: F.greatest(F.least(F.rint(v / scale), F.lit(top)), F.lit(-top)).cast("int")))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda v: v * scale)


def blocks(x: Column, size: int = BLOCK) -> Column:
    """Runs of `size` elements; the last one is what is left."""
    return bind(x, lambda y: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(y) / size).cast("int"), F.lit(1)) - 1), lambda i: F.slice(y, i * size + 1, size)))


def power_scale(value: Column, top: float) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(value / top)).cast("double"))


def block_scales(x: Column, size: int = BLOCK, top: float = E4M3_MAX) -> Column:
    """2^ceil(log2(amax / top)) of each block."""
    return F.transform(blocks(x, size), lambda b: power_scale(F.greatest(amax(b), F.lit(TINY)), top))


def sigma_scales(x: Column, size: int = BLOCK, factor: float = 3.0) -> Column:
    """As block_scales, of factor times the population deviation; of amax for blocks that hardly vary."""

    def one(b: Column) -> Column:
        spread = bind(mean(b), lambda m: F.greatest(F.sqrt(mean(F.transform(b, lambda v: (v - m) * (v - m)))), F.lit(TINY)))
        return bind(spread, lambda s: power_scale(F.when(s < 1e-6, F.greatest(amax(b), F.lit(TINY))).otherwise(s * factor), E4M3_MAX))

    return F.transform(blocks(x, size), one)


def _round_float(v: Column, mantissa: int, least: int, top: float) -> Column:
    clamped = F.greatest(F.least(v, F.lit(top)), F.lit(-top))
    exponent = F.greatest(F.floor(F.log2(F.greatest(F.abs(clamped), F.lit(1e-300)))).cast("double"), F.lit(float(least)))
    ulp = F.pow(F.lit(2.0), exponent - mantissa)
    return F.greatest(F.least(F.rint(clamped / ulp) * ulp, F.lit(top)), F.lit(-top))


def e4m3(v: Column) -> Column:
    """Nearest value of three mantissa bits, halves to even, within +-448."""
    return _round_float(v, 3, -6, E4M3_MAX)


def e5m2(v: Column) -> Column:
    return _round_float(v, 2, -14, E5M2_MAX)


def fp8_cast(x: Column, kind: str = "e4m3") -> Column:
    """Values after a cast with one scale for the vector: top / amax."""
    top, cast = (E4M3_MAX, e4m3) if kind == "e4m3" else (E5M2_MAX, e5m2)
    return bind(x, lambda y: bind(F.lit(top) / F.greatest(amax(y), F.lit(TINY)), lambda scale: F.transform(y, lambda v: cast(v * scale) / scale)))


def stochastic_e4m3(v: Column, u: Column) -> Column:
    """One of the two E4M3 neighbours of v, the farther from zero with the share of the gap that v has crossed."""
    size = F.least(F.abs(v), F.lit(E4M3_MAX))
    ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-300)))).cast("double"), F.lit(-6.0)) - 3)
    low = F.floor(size / ulp)
    return F.signum(v) * F.least((low + F.when(u < size / ulp - low, 1).otherwise(0)) * ulp, F.lit(E4M3_MAX))


def stochastic_cast(x: Column, key: Column, seed: int = 42) -> Column:
    """fp8_cast with stochastic rounding; each element's draw depends on seed, key and place."""
    cast = lambda y, scale: F.transform(y, lambda v, i: stochastic_e4m3(v * scale, u01(seed, "round", key, i)) / scale)
    return bind(x, lambda y: bind(F.lit(E4M3_MAX) / F.greatest(amax(y), F.lit(TINY)), lambda scale: cast(y, scale)))


def sigma_cast(x: Column, factor: float = 3.0) -> Column:
    """fp8_cast whose scale covers `factor` sample deviations; amax for vectors that hardly vary."""

    def deviation(y: Column) -> Column:
        squares = bind(mean(y), lambda m: F.aggregate(F.transform(y, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, v: a + v))
        return F.greatest(F.sqrt(squares / F.greatest(F.size(y) - 1, F.lit(1))), F.lit(TINY))

    top = lambda y: bind(deviation(y), lambda s: F.when(s < 1e-6, F.greatest(amax(y), F.lit(TINY))).otherwise(s * factor))
    return bind(x, lambda y: bind(F.lit(E4M3_MAX) / top(y), lambda scale: F.transform(y, lambda v: e4m3(v * scale) / scale)))


def scaled(x: Column, scales: Column, size: int = BLOCK, reverse: bool = False) -> Column:
    """Each block divided by its scale, or multiplied."""
    parts = F.zip_with(blocks(x, size), scales, lambda b, s: F.transform(b, lambda v: v * s if reverse else v / s))
    return F.flatten(parts)


def nf4_codebook() -> list[float]:
    """Sixteen levels at normal quantiles (2i+1)/16, symmetric, the largest 1."""
    up = [NormalDist().inv_cdf((1 + (i + 0.5) / 8) / 2) for i in range(8)]
    return [-v / up[-1] for v in reversed(up)] + [v / up[-1] for v in up]


def residual_quantize(x: Column, size: int = BLOCK, nf4: bool = False, sigma: bool = False) -> Column:
    """struct<main, resid, main_scales, resid_scales>: FP8 values, 4-bit residuals and both kinds of block scales."""
    book = nf4_codebook()
    middles = [(p + q) / 2 for p, q in zip(book, book[1:], strict=False)]

    def level(v: Column) -> Column:
        if not nf4:
            return F.greatest(F.least(F.rint(v), F.lit(7.0)), F.lit(-7.0)).cast("int")
        return F.size(F.filter(F.array(*[F.lit(m) for m in middles]), lambda m: m < F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0))))

    def block(b: Column) -> Column:
        """One block: its scale, FP8 values, their residual's scale and levels."""
        scale = F.get(sigma_scales(b, size) if sigma else block_scales(b, size), F.lit(0))

        def inner(s: Column) -> Column:
            def cast(y: Column) -> Column:
                def rest(main: Column) -> Column:
                    left = F.zip_with(y, main, lambda p, q: p - q)
                    rs = power_scale(F.greatest(amax(left), F.lit(TINY)), 1.0 if nf4 else 7.0)
                    return bind(rs, lambda r: F.struct(main.alias("main"), F.transform(left, lambda v: level(v / r)).alias("resid"), s.alias("scale"), r.alias("resid_scale")))

                return bind(F.transform(y, e4m3), rest)

            return bind(F.transform(b, lambda v: v / s), cast)

        return bind(scale, inner)

    def gathered(made: Column) -> Column:
        flat = lambda name: F.flatten(F.transform(made, lambda m: m[name]))
        return F.struct(flat("main").alias("main"), flat("resid").alias("resid"), F.transform(made, lambda m: m["scale"]).alias("main_scales"), F.transform(made, lambda m: m["resid_scale"]).alias("resid_scales"))

    return bind(F.transform(blocks(x, size), block), gathered)


def residual_dequantize(q: Column, size: int = BLOCK, nf4: bool = False) -> Column:
    book = F.array(*[F.lit(v) for v in nf4_codebook()])
    values = F.transform(q["resid"], lambda i: F.get(book, i) if nf4 else i.cast("double"))
    return scaled(F.zip_with(q["main"], scaled(values, q["resid_scales"], size, True), lambda a, b: a + b), q["main_scales"], size, True)


def snr_db(x: Column, y: Column) -> Column:
    """10 log10(mean x^2 / mean (x-y)^2); null for no signal, infinity for no noise."""
    signal = mean(F.transform(x, lambda v: v * v))
    noise = mean(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))
    return F.when(signal < 1e-20, F.lit(None).cast("double")).when(noise < 1e-20, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(signal / noise))


def block_exponents(x: Column, size: int = BLOCK) -> Column:
    """Exponents of the block scales, not below -126."""
    return F.transform(blocks(x, size), lambda b: F.greatest(F.ceil(F.log2(F.greatest(amax(b), F.lit(TINY)) / E4M3_MAX)).cast("int"), F.lit(-126)))


def block_cast(x: Column, size: int = BLOCK) -> Column:
    """Values after an FP8 cast with a power of two as each block's scale."""

    def one(b: Column) -> Column:
        return bind(power_scale(F.greatest(amax(b), F.lit(TINY)), E4M3_MAX), lambda s: F.transform(b, lambda v: e4m3(v / s) * s))

    return bind(x, lambda y: F.flatten(F.transform(blocks(y, size), one)))


def dual(x: Column, error: Column | None = None, size: int = BLOCK) -> Column:
    """struct<hi, lo, error>: FP8 values by blocks, those of what they leave, and what both leave.

    With an error buffer, x is corrected by it first; the error that comes out is the next buffer.
    """
    less = lambda p, q: F.zip_with(p, q, lambda a, b: a - b)
    corrected = x if error is None else F.zip_with(x, error, lambda a, b: a + b)

    def parts(y: Column) -> Column:
        rest = lambda hi, left: bind(block_cast(left, size), lambda lo: F.struct(hi.alias("hi"), lo.alias("lo"), less(left, lo).alias("error")))
        return bind(block_cast(y, size), lambda hi: bind(less(y, hi), lambda left: rest(hi, left)))

    return bind(corrected, parts)


def softmax_loss(logits: Column, target: Column) -> Column:
    """logsumexp less the target's logit; null for a masked target, -1."""
    return F.when(target >= 0, logsumexp(logits) - F.get(logits, target))


def masked_loss(loss: Column) -> Column:
    """Mean of softmax_loss over rows whose target isn't masked, 0 without any: an aggregate."""
    return F.coalesce(F.avg(loss), F.lit(0.0))


def z_loss(logits: Column, alpha: float = 1e-4) -> Column:
    """alpha times the mean square of logsumexp: an aggregate."""
    size = logsumexp(logits)
    return F.coalesce(F.avg(size * size), F.lit(0.0)) * alpha


def logsumexp(x: Column) -> Column:
    return bind(F.array_max(x), lambda top: top + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)))


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    return bind(F.sqrt(mean(F.transform(x, lambda v: v * v)) + eps), lambda size: F.transform(x, lambda v: v / size))


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become null; ties with it stay."""
    place = F.least(F.lit(k), F.size(logits)) - 1
    return bind(F.get(F.sort_array(logits, False), place), lambda cut: F.transform(logits, lambda v: F.when(v >= cut, v)))


def top_p(logits: Column, p: float) -> Column:
    """The least set of largest logits whose probability reaches p; others become null, and nulls stay so."""

    def cut(ordered: Column, total: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("last"))
        # Largest first: a value is kept while those before it sum up to less than p.
        end = F.aggregate(ordered, start, lambda a, v: F.when(a["sum"] < p, F.struct((a["sum"] + F.exp(v - total)).alias("sum"), v.alias("last"))).otherwise(a))
        return end["last"]

    def kept(x: Column) -> Column:
        least = bind(F.filter(x, lambda v: v.isNotNull()), lambda live: bind(logsumexp(live), lambda total: cut(F.sort_array(live, False), total)))
        return bind(least, lambda c: F.transform(x, lambda v: F.when(v >= c, v)))

    return bind(logits, kept)


def sampled_token(logits: Column, u: Column, temperature: float = 0.8, k: int = 50, p: float = 0.95) -> Column:
    """The index that the uniform number u draws after temperature, top-k and top-p; the largest logit's without heat."""
    if temperature <= 0:
        return bind(logits, lambda x: F.array_position(x, F.array_max(x)) - 1).cast("int")

    def drawn(weights: Column, target: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        after = lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["n"] + F.when(a["sum"] + v <= target, 1).otherwise(0)).alias("n"))
        return F.least(F.aggregate(weights, start, after)["n"], F.size(weights) - 1)

    def choose(x: Column) -> Column:
        weights = bind(F.array_max(x), lambda top: F.transform(x, lambda v: F.coalesce(F.exp(v - top), F.lit(0.0))))
        return bind(weights, lambda w: bind(F.aggregate(w, F.lit(0.0), lambda a, v: a + v) * u, lambda target: drawn(w, target)))

    heated = F.transform(logits, lambda v: v / temperature)
    cut = bind(heated, lambda x: top_k(x, k)) if k > 0 else heated
    return bind(top_p(cut, p) if p < 1 else cut, choose)


def penalised(logits: Column, seen: Column, repetition: float, frequency: float) -> Column:
    """Logits of seen tokens divided by the penalty, or multiplied if negative, less the frequency penalty by count."""
    def one(v: Column, i: Column) -> Column:
        count = F.size(F.filter(seen, lambda t: t == i))
        shifted = F.when(v > 0, v / repetition).otherwise(v * repetition)
        return F.when(count > 0, shifted - frequency * count).otherwise(v)

    return F.transform(logits, one)


def bits_per_value(size: int) -> float:
    return 12 + 16 / size


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def rope_angle(position: Column, pair: Column, head_dim: int, theta: float = 10000.0, scaling: str | None = None, factor: float = 1.0) -> Column:
    """Rotation angle of a position and a pair of dimensions; linear, ntk and yarn scaling."""
    base = theta * factor ** (head_dim / (head_dim - 2)) if scaling in ("ntk", "yarn") else theta
    at = position / factor if scaling == "linear" else position
    angle = at * F.exp(-pair * 2.0 / head_dim * math.log(base))
    if scaling == "yarn":
        blend = F.greatest(F.least((pair / (head_dim // 2) - 0.25) / 0.5, F.lit(1.0)), F.lit(0.0))
        angle = angle * ((1 - blend) + blend / factor)
    return angle
