"""Size estimates and the choice of a plan, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a word, reserve of a context, greatest compression that one pass may do, accepted lengths,
#: shares of a context for content and for output, growth allowed to a chunk's output.
TOKENS_PER_WORD, BUFFER, FIDELITY, SHORT, LONG, CONTENT_SHARE, OUTPUT_SHARE, CHUNK_GROWTH = 1.35, 0.15, 15, 0.80, 1.30, 0.60, 0.20, 1.25


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _int(c: Column) -> Column:
    """Towards zero."""
    return c.cast("double").cast("bigint")


def tokens(text: str | Column) -> Column:
    """Tokens by a rule that needs no vocabulary: runs of letters and digits, and single other signs."""
    return F.regexp_count(_col(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def words_to_tokens(n) -> Column:
    return _int(_col(n) * TOKENS_PER_WORD)


def tokens_to_words(n) -> Column:
    return _int(_col(n) / TOKENS_PER_WORD)


def headroom(ctx) -> Column:
    return _col(ctx) - _int(_col(ctx) * BUFFER)


def path(t_doc, t_target, ctx, force=False) -> Column:
    """``alpha`` (one pass) if text and target fit the context and the compression is under 15, else ``beta``."""
    fits = _col(t_doc) + _col(t_target) < headroom(ctx)
    faithful = (_col(t_target) > 0) & (_col(t_doc) < FIDELITY * _col(t_target))
    return F.when(~_col(force) & fits & faithful, "alpha").otherwise("beta")


def chunk_output(ctx, t_target, chunks) -> Column:
    """Output budget of one chunk."""
    return F.least(_int(_col(ctx) * OUTPUT_SHARE), F.greatest(F.lit(64), _int(_col(t_target) * CHUNK_GROWTH / _col(chunks))))


def refine_budget(ctx, t_target) -> Column:
    """What the second model can take: its context less the reserve and a target that may grow."""
    return _int(_col(ctx) * (1 - BUFFER)) - words_to_tokens(_int(tokens_to_words(t_target) * 1.4))


def cleanup_mode(t_doc, ctx) -> Column:
    """``single`` if prompt, text and an output a fifth longer fit 85 % of the context, else ``chunked``."""
    out = F.greatest(F.lit(512), _int(_col(t_doc) * 1.2))
    return F.when(600 + _col(t_doc) + out <= _int(_col(ctx) * 0.85), "single").otherwise("chunked")


def length_check(t_actual, t_target) -> Column:
    """``expand``, ``condense`` or ``ok``; a target of 0 is always met."""
    ratio = F.when(_col(t_target) > 0, _col(t_actual) / _col(t_target)).otherwise(F.lit(1.0))
    return F.when(ratio < SHORT, "expand").when(ratio > LONG, "condense").otherwise("ok")


def delta_percent(before, after) -> Column:
    return F.when(_col(before) > 0, F.round((_col(after) - _col(before)) * 100.0 / _col(before), 1)).otherwise(F.lit(0.0))


def coarse_grid(layers, size_bytes, vram_mb) -> Column:
    """Numbers of layers to try first: none, all, the predicted fit and steps around it."""
    n = F.coalesce(_col(layers), F.lit(32))
    layer = F.when(_col(size_bytes) > 0, _col(size_bytes) / 1048576 / n).otherwise(F.lit(0.0))
    usable = F.greatest(F.lit(0), _int(_col(vram_mb) * 0.8) - 700)
    fit = F.least(n, F.greatest(F.lit(0), F.when(layer > 0, _int(usable / layer)).otherwise(n))).cast("int")
    stride = F.greatest(F.lit(2), F.floor(n / 12).cast("int"))
    lo, hi = F.greatest(F.lit(0), fit - 3 * stride), F.least(n, fit + 3 * stride)
    return F.array_sort(F.array_distinct(F.concat(F.array(n.cast("int"), F.lit(0), fit), F.sequence(lo.cast("int"), hi.cast("int"), stride))))


def fine_grid(best, layers, tried) -> Column:
    """Two steps around the best, without what was tried."""
    return F.array_except(F.sequence(F.greatest(F.lit(0), _col(best) - 2), F.least(_col(layers), _col(best) + 2)), _col(tried))


def tier(value, ladder: list[tuple[float, int]], top: int) -> Column:
    """The first step of a ladder whose bound is above the value, else ``top``."""
    out = F
    for bound, step in ladder:
        out = out.when(_col(value) < bound, step)
    return out.otherwise(top)


#: Batch sizes by gigabytes of graphics memory.
BATCH_LADDER = [(6, 1), (8, 2), (16, 4), (32, 8)]


def viable(ttft, decode_rate, error) -> Column:
    """A run without error that answers within 5 s (0 or missing: never) and decodes more than 3 tokens a second."""
    return _col(error).isNull() & (F.coalesce(F.nullif(_col(ttft), F.lit(0.0)), F.lit(999.0)) < 5) & (F.coalesce(_col(decode_rate), F.lit(0.0)) > 3)


def rate(count, nanoseconds) -> Column:
    return F.when(F.coalesce(_col(nanoseconds), F.lit(0)) != 0, _col(count) / (_col(nanoseconds) / 1e9)).otherwise(F.lit(0.0))


#: Encoding sessions of a graphics card by megabytes of its memory.
SESSIONS = [(4000, 1), (6000, 2), (8000, 3), (12000, 5)]


def worker_defaults(cores, vendor, cuda, rocm, vram_mb) -> Column:
    """Settings by hardware: threads, sessions of the card, processes for small pictures and for raw ones. ``vendor`` is null without a card."""
    c, card = _col(cores), _col(vendor).isNotNull()
    threads = F.when(_col(cuda) | _col(rocm), F.greatest(F.lit(1), c - 4)).when(_col(vendor) == "intel", F.greatest(F.lit(1), c - 2)).otherwise(c)
    sessions = F.when(_col(cuda), tier(vram_mb, SESSIONS, 8)).when(_col(rocm), 3).otherwise(0)
    small = F.when(card, F.greatest(F.lit(1), c - 2)).otherwise(F.greatest(F.lit(1), _int(c * 0.8)))
    return F.struct(threads.alias("threads"), sessions.alias("sessions"), small.cast("int").alias("thumbnail_cores"), c.alias("raw_cores"))
