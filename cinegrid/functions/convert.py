"""Sample conversion as Column expressions. Single precision is kept by FLOAT literals, so results do not depend on promotion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrid.functions import tables as t
from cinegrid.operators.timeline import int_div, long


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def clean(x: Column) -> Column:
    """A float sample; not-a-number counts as zero."""
    return F.when(F.isnan(x), f32(0)).otherwise(x)


def quantise(x: Column, bits: int) -> Column:
    """A float in [0, 1] as an integer sample, rounded half up; values outside are clamped."""
    unit = F.least(F.greatest(x, f32(0)), f32(1))
    return F.floor(unit * f32((1 << bits) - 1) + f32(0.5)).cast("int")


def widen(sample: Column, bits: int) -> Column:
    """A sample of 8 to 16 bits as 16 bits, its high bits repeated below."""
    return F.shiftleft(sample, 16 - bits).bitwiseOR(F.shiftright(sample, 2 * bits - 16))


def reduce_depth(sample: Column, source: int, target: int) -> Column:
    """A sample scaled to fewer bits, rounded half up."""
    s, d = (1 << source) - 1, (1 << target) - 1
    return int_div(sample.cast("bigint") * long(2 * d) + long(s), 2 * s).cast("int")


def depth_shift(sample: Column, frame_bits: Column | int, word_bits: int = 16) -> Column:
    """A left-aligned word as a sample of the frame's bits."""
    shift = F.lit(word_bits) - (F.lit(frame_bits) if isinstance(frame_bits, int) else frame_bits)
    return F.call_function("shiftright", sample, shift.cast("int"))


def bit_expand(value: Column, bits: int, rule: str) -> Column:
    """A sample of few bits as 8 bits: `round` (BMP, TGA), `truncate` (DDS, narrow TIFF) or `float` (PNM)."""
    most = (1 << bits) - 1
    v = value.cast("bigint")
    if rule == "round":
        return int_div(v * long(255) + long(most // 2), most).cast("int")
    if rule == "truncate":
        return int_div(v * long(255), most).cast("int")
    return F.round(value.cast("float") * f32(float_ratio(255, most))).cast("int")


def float_ratio(a: int, b: int) -> float:
    import numpy as np

    return float(np.float32(a) / np.float32(b))


def matrix_of(code: Column) -> Column:
    """The code itself; codes without a meaning are refused."""
    return F.when(code.isin(t.MATRIX_CODES), code).otherwise(F.raise_error(F.concat(F.lit("unknown matrix code "), code.cast("string"))))


def coefficient(matrix: Column, which: int) -> Column:
    """kr (0) or kb (1) of a matrix code, null for codes that cannot be converted."""
    out = F.lit(None).cast("float")
    for code, pair in t.COEFFICIENTS.items():
        out = F.when(matrix == code, f32(pair[which])).otherwise(out)
    return out


def yuv_to_rgb(y: Column, cb: Column, cr: Column, matrix: Column, full: Column, bits: int, precision: int) -> Column:
    """Struct r, g, b of integer samples; matrix 0 scales all three planes as luma. All inputs are samples (FLOAT)."""
    step, most = 1 << (bits - 8), (1 << bits) - 1
    luma = F.when(full, y * f32(float_ratio(1, most))).otherwise((y - f32(16 * step)) * f32(float_ratio(1, 219 * step)))

    def as_luma(v: Column) -> Column:
        return F.when(full, v * f32(float_ratio(1, most))).otherwise((v - f32(16 * step)) * f32(float_ratio(1, 219 * step)))

    def as_chroma(v: Column) -> Column:
        return F.when(full, (v - f32(1 << (bits - 1))) * f32(float_ratio(1, most))).otherwise((v - f32(128 * step)) * f32(float_ratio(1, 224 * step)))

    kr, kb = coefficient(matrix, 0), coefficient(matrix, 1)
    kg = f32(1) - kr - kb
    b, r = as_chroma(cb), as_chroma(cr)
    red = luma + f32(2) * (f32(1) - kr) * r
    green = luma - (f32(2) * kb * (f32(1) - kb) / kg).cast("float") * b - (f32(2) * kr * (f32(1) - kr) / kg).cast("float") * r
    blue = luma + f32(2) * (f32(1) - kb) * b
    plain = matrix == 0
    return F.struct(
        quantise(F.when(plain, luma).otherwise(red).cast("float"), precision).alias("r"),
        quantise(F.when(plain, as_luma(cb)).otherwise(green).cast("float"), precision).alias("g"),
        quantise(F.when(plain, as_luma(cr)).otherwise(blue).cast("float"), precision).alias("b"),
    )


def lerp(a: Column, b: Column, w: Column) -> Column:
    return a * (f32(1) - w) + b * w


def chroma_at(grid: Column, width: int, height: int, x: Column, y: Column, sub: tuple[int, int], phase: tuple[Column, Column]) -> Column:
    """The chroma sample (FLOAT array, row-major) at a luma position, interpolated across, then down."""

    def taps(at: Column, step: int, ph: Column, count: int) -> tuple[Column, Column, Column]:
        pos = ((at.cast("float") - (ph if step > 1 else f32(0))) / f32(step)).cast("float")
        low = F.floor(pos)
        weight = (pos - low.cast("float")).cast("float")
        first = F.least(F.greatest(low, long(0)), long(count - 1))
        after = F.when(weight == 0, first).otherwise(F.least(F.greatest(low + 1, long(0)), long(count - 1)))
        return first, after, weight

    x0, x1, wx = taps(x, sub[0], phase[0], width)
    y0, y1, wy = taps(y, sub[1], phase[1], height)

    def value(cx: Column, cy: Column) -> Column:
        return F.get(grid, (cy * width + cx).cast("int"))

    return lerp(lerp(value(x0, y0), value(x1, y0), wx), lerp(value(x0, y1), value(x1, y1), wx), wy)


def cmyk_to_rgb(ink: Column, black: Column, most: int) -> Column:
    """One RGB sample of inverted ink: truncated, in single precision."""
    left = f32(1) - (black.cast("float") / f32(most)).cast("float")
    return F.floor((f32(most) - ink.cast("float")) * left).cast("int")


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, kr: float = 0.299, kb: float = 0.114) -> Column:
    """Struct r, g, b of 8-bit samples in double precision, rounded half away from zero and clamped."""
    kg = 1.0 - kr - kb
    yy, b, r = (c.cast("double") for c in (y, cb, cr))
    b, r = b - 128.0, r - 128.0
    red, blue = yy + r * (2.0 - 2.0 * kr), yy + b * (2.0 - 2.0 * kb)
    green = yy - b * ((2.0 - 2.0 * kb) * kb / kg) - r * ((2.0 - 2.0 * kr) * kr / kg)

    def byte(v: Column) -> Column:
        return F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(255.0)).cast("int")

    return F.struct(byte(red).alias("r"), byte(green).alias("g"), byte(blue).alias("b"))


def sycc_to_rgb(y: Column, cb: Column, cr: Column, bits: int) -> Column:
    """Struct r, g, b of the JPEG 2000 fallback, in single precision."""
    most = float((1 << bits) - 1)
    yy, b, r = ((c.cast("float") / f32(most)).cast("float") for c in (y, cb, cr))
    b, r = b - f32(0.5), r - f32(0.5)

    def sample(v: Column) -> Column:
        return F.round(F.least(F.greatest(v, f32(0)), f32(1)) * f32(most)).cast("int")

    return F.struct(
        sample(yy + f32(1.402) * r).alias("r"), sample(yy - f32(0.344136) * b - f32(0.714136) * r).alias("g"), sample(yy + f32(1.772) * b).alias("b"),
    )


def radiance(c: Column, e: Column) -> Column:
    """A shared-exponent sample as FLOAT: c * 2^(e - 136); exponent 0 is black."""
    return F.when(e == 0, f32(0)).otherwise((c.cast("double") * F.pow(F.lit(2.0), (e - 136).cast("double"))).cast("float"))


def yuv_refusal(bits: Column, precision: Column, across: Column, down: Column, width: Column, height: Column, matrix: Column) -> Column:
    """Why a YUV picture cannot be converted; null where it can. across, down: bits that its chroma is subsampled by."""
    chroma = (F.call_function("shiftright", width, across) == 0) | (F.call_function("shiftright", height, down) == 0)
    return (
        F.when(~bits.between(8, 16), "depth").when(~precision.between(1, 16), "precision").when(~across.between(0, 1) | ~down.between(0, 1), "subsampling")
        .when(~matrix.isin(t.MATRIX_CODES), "unknown matrix").when(F.coalesce(matrix, F.lit(2)) == 2, "matrix not stated")
        .when(matrix.isin(10, 13, 14), "constant luminance").when(matrix == 12, "derived matrix").when(chroma, "no chroma sample")
    )


def yuv_matrix(given: Column, stated: Column, refuse: bool = True) -> Column:
    """The matrix a YUV picture is read with: the one given, else the one it states. None at all is an error (or null), and so is a
    stated code that names no matrix."""
    named = F.when(stated.isin(t.MATRIX_CODES) & (stated != 2), stated).cast("int")
    if not refuse:
        return F.coalesce(given.cast("int"), named)
    unknown = F.raise_error(F.concat(F.lit("the picture states an unknown matrix: "), stated.cast("string"))).cast("int")
    none = F.raise_error(F.lit("the picture states no matrix; name the one it was coded with")).cast("int")
    return F.coalesce(given.cast("int"), named, F.when(~stated.isin(t.MATRIX_CODES), unknown).otherwise(none))


def sample_word(sample: Column, depth: Column) -> Column:
    """A decoded sample of `depth` bits as the word of its buffer: more than 8 bits are left-aligned in 16."""
    value = F.least(F.greatest(F.round(sample), F.lit(0.0)), (F.call_function("shiftleft", F.lit(1), depth) - 1).cast("double")).cast("int")
    return F.when(depth > 8, F.call_function("shiftleft", value, 16 - depth)).otherwise(value)


def palette_entry(palette: Column, index: Column) -> Column:
    """The colours (array) of an index; one beyond the palette is an error."""
    at = F.greatest(F.round(index), F.lit(0)).cast("int")
    return F.when(at >= F.size(palette), F.raise_error(F.lit("a palette index is past the end of the palette")).cast("array<int>")).otherwise(F.get(palette, at))
