"""Statistics of a text, and what kind of text it is: prose, list, table or junk.

All statistics are built-in Spark expressions over the whole text: shares of common words, symbols, digits, repetitions,
and of characters in lines of which a measure (cells, marks of entries, broken words and so on) reaches a level. What
tells the kinds apart is learned: an ordered list of rules over all these statistics is induced by incremental
reduced-error pruning on labelled documents and exported as an SQL CASE expression, which Spark applies natively. The
labelled documents, a documented number, are made from sentences of a bounded sample of the corpus.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("junk", "table", "list")


#: Measures of a line that its shape tells; in a shape every run of letters is an ``a`` and every run of digits a ``0``.
_COUNT = lambda sign: f"(length(x.sh) - length(replace(x.sh, {sign}, '')))"
#: The number of the most frequent separator; lines without any are told by one look at their shape.
_CELLS = rf"""if(x.sh rlike '[|;\\t&]|,\\S|  ', greatest({_COUNT("'|'")}, {_COUNT("chr(9)")}, {_COUNT("';'")}, {_COUNT("' & '")} div 3,
  regexp_count(x.sh, ',(?=\\S)'), regexp_count(x.sh, '\\S {{2,}}(?=\\S)')), 0)"""
#: Places where a word is broken by digits or by signs other than apostrophes and hyphens.
_ODD = r"'a0|0a|a[^a0\\s\'’-]+a'"
_MARK = r"x.l rlike '^\\s*([-*+•·‣◦▪–—○●■□✓]|\\[[ xX]?\\]|\\(?(\\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)\\]:])\\s+\\S'"
#: Per line, n: characters without the spaces around it, m: words, c: common words, a: letters and digits, v: all but
#: spaces, cells, odd: see above, tag, lead: a leader of dots, mark: an entry's mark, end: ends like a sentence.
_MEASURES = rf"""named_struct('n', bigint(x.n), 'm', size(x.w), 'c', x.c, 'a', x.a, 'v', length(x.l) - {_COUNT("' '")} - {_COUNT("chr(9)")},
  'cells', {_CELLS}, 'odd', if(x.sh rlike {_ODD}, regexp_count(x.sh, {_ODD}), 0), 'tag', instr(x.sh, '<a') > 0 or instr(x.sh, '</a') > 0,
  'lead', x.sh rlike '[.]{{4}}|[.] [.] [.]|…{{2}}|_{{4}}', 'mark', {_MARK}, 'end', right(rtrim(x.sh), 4) rlike '[.!?:;,…]["\')*_\\]]*$')"""

#: Statistics that are shares of a text's characters: those in lines of which a measure reaches a level. No level decides
#: what a line is; which of them tell the kinds apart, and how great a share must be, is learned.
LINE_SHARES = {
    "marked": "x.mark", "tagged": "x.tag", "leaders": "x.lead", "open_ends": "not x.end",
    "words_upto_4": "x.m <= 4 and not x.end", "words_upto_8": "x.m <= 8 and not x.end",
    "cells_of_3_words": "x.cells >= 1 and x.m <= 3 * (x.cells + 1)", "cells_of_8_words": "x.cells >= 2 and x.m <= 8 * (x.cells + 1)", "cells_from_4": "x.cells >= 3",
    "alnum_under_40": "x.a < 0.4D * x.v", "alnum_under_60": "x.a < 0.6D * x.v", "alnum_under_80": "x.a < 0.8D * x.v",
    "common_upto_5": "x.m >= 5 and x.c <= 0.05D * x.m", "common_upto_10": "x.m >= 5 and x.c <= 0.1D * x.m", "common_upto_25": "x.m >= 5 and x.c <= 0.25D * x.m",
    "odd_from_10": "x.odd > 0 and x.odd >= 0.1D * x.m", "odd_from_30": "x.odd > 0 and x.odd >= 0.3D * x.m", "letters_upto_1_6": "x.m >= 6 and x.a <= 1.6D * x.m", "letters_from_15": "x.m >= 1 and x.a >= 15 * x.m",
}

#: All statistics; the rules may use any but those of size and of layout, which tell what a text is like and not its kind.
FEATURES = (
    "words", "mean_word_length", "words_per_line", "line_end_share", "symbol_ratio", "digit_ratio", "upper_inside", "common_share", "types_share", "repeated_lines", "repeated_pieces",
    *LINE_SHARES,
)
RULE_FEATURES = FEATURES[4:]


def _once(*columns: F.Column) -> F.Column:
    """Columns that are computed once: the optimizer copies no expression through a generator."""
    return F.inline(F.array(F.struct(*columns)))


def text_statistics(documents: DataFrame, common: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` (and columns to keep) and the statistics of its text; shares are of its characters unless they are of words or lines.

    Null and blank texts have 0 words and 0 in every share. A text is read whole, whatever its length.
    """
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted({w.lower() for w in common if w})) or "''"
    share = lambda part, whole: f"coalesce(double({part}) / nullif({whole}, 0), 0D)"
    total = lambda x: f"aggregate(lines, 0L, (s, x) -> s + {x})"
    df = documents.select("doc_id", *keep, F.expr(r"coalesce(text, '')").alias("text"))
    raw = r"""transform(split(text, '\\r\\n|\\n|\\r'), l -> named_struct('l', l, 'n', length(trim(l)), 'w', regexp_extract_all(lower(l), '[\\p{L}\\p{N}]+', 0)))"""
    df = df.select("doc_id", *keep, "text", _once(F.expr(raw).alias("raw")))
    shaped = rf"""transform(raw, r -> named_struct('l', r.l, 'n', r.n, 'w', r.w, 'c', size(filter(r.w, v -> v in ({listed}))), 'a', length(array_join(r.w, '')),
        'sh', regexp_replace(regexp_replace(r.l, '\\p{{L}}+', 'a'), '\\p{{N}}+', '0')))"""
    df = df.select("doc_id", *keep, "text", _once(F.expr(shaped).alias("raw")))
    df = df.select("doc_id", *keep, "text", _once(
        F.expr(f"transform(raw, x -> {_MEASURES})").alias("lines"),
        F.expr("flatten(transform(raw, x -> x.w))").alias("w"),
        F.expr("filter(transform(raw, x -> x.l), v -> trim(v) != '')").alias("full"),
        F.expr(r"array_remove(split(text, '[.!?\\n\\r][.!?\\s]*|\\s{2,}'), '')").alias("pieces"),
    ))
    df = df.select("*", _once(
        F.expr(total("x.n")).alias("n"), F.expr(total("x.c")).alias("c"), F.expr(total("x.a")).alias("alnum"), F.expr(total("x.v")).alias("visible"),
        F.expr(r"length(regexp_replace(text, '[^\\p{N}]+', ''))").alias("digits"),
    ))
    stats = _once(
        F.expr("size(w)").alias("words"),
        F.expr(share("alnum", "size(w)")).alias("mean_word_length"),
        F.expr(share("size(w)", "size(full)")).alias("words_per_line"),
        F.expr(share("size(filter(lines, x -> x.n > 0 and x.end))", "size(full)")).alias("line_end_share"),
        F.expr(share("greatest(visible - alnum, 0)", "n")).alias("symbol_ratio"),
        F.expr(share("digits", "n")).alias("digit_ratio"),
        F.expr(share(r"regexp_count(text, '\\p{Ll}\\p{Lu}')", "size(w)")).alias("upper_inside"),
        F.expr(share("c", "size(w)")).alias("common_share"),
        F.expr(share("aggregate(sequence(1, greatest(size(w), 1), 40), 0L, (s, i) -> s + size(array_distinct(slice(w, i, 40))))", "size(w)")).alias("types_share"),
        F.expr(share("size(full) - size(array_distinct(full))", "size(full)")).alias("repeated_lines"),
        F.expr(share("size(pieces) - size(array_distinct(pieces))", "size(pieces)")).alias("repeated_pieces"),
        *[F.expr(share(total(f"if({level}, x.n, 0)"), "n")).alias(name) for name, level in LINE_SHARES.items()],
    )
    return df.select("doc_id", *keep, stats)


# --- labelled documents ---------------------------------------------------------------------------------------------


#: Parts of invented words, as they are common in European languages.
_ONSETS = "b c d f g h j k l m n p qu r s t v w z bl br ch cl cr dr fl fr gl gr pl pr sch sh sp st str th tr".split()
_VOWELS = "a a a e e e e i i i o o u ai au ea ie ou ei é á ü".split()
_CODAS = "n n r r s t l m d ck ch cht ft ld lt mpt nd ng ngs nk ns nt rd rm rn rst rt sch st ts x".split()


class _Maker:
    """Makes texts of a known kind from function words and invented words, most of them from sentences and words of the corpus."""

    def __init__(self, common: dict[str, list[str]], seed: int, bank: list[str] = ()):
        self.r = random.Random(seed)
        self.bank = list(bank)
        listed = {w for ws in common.values() for w in ws}
        self.corpus_words = sorted({w for s in self.bank for w in re.findall(r"[^\W\d_]{4,}", s) if w.lower() not in listed})
        self.real = False
        self.common = {k: [w for w in v if w] for k, v in sorted(common.items()) if v} or {"": ["the", "of", "and"]}

    def word(self) -> str:
        """A word that can be spoken: syllables with clusters of consonants, some with an accent, some joined by a hyphen."""
        r = self.r
        out = "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + (r.choice(_CODAS) if r.random() < 0.5 else "") for _ in range(r.choice([1, 1, 2, 2, 2, 3, 3, 4])))
        out = out.capitalize() if r.random() < self.names else out
        return f"{out}-{r.choice(_ONSETS)}{r.choice(_VOWELS)}{r.choice(_CODAS)}" if r.random() < 0.02 else out

    def content(self) -> str:
        return self.r.choice(self.stock)

    def sentence(self, least: int = 6, most: int = 16) -> str:
        r, small = self.r, self.common[self.lang]
        if self.real and least > 4:
            return r.choice(self.bank)
        words = [r.choice(small) if r.random() < self.small else self.content() for _ in range(r.randint(least, most))]
        if r.random() < 0.1:
            words[r.randrange(len(words))] = r.choice(["4K", "120", "300dpi", "2,300", "mp3", "9"])
        if r.random() < 0.3:
            words[r.randrange(len(words) - 1)] += ","
        return (" ".join(words)).capitalize() + r.choice(["."] * 8 + ["?", "!"])

    def prose(self, size: int) -> str:
        r, out = self.r, []
        style = r.choice(["plain", "plain", "wrapped", "chat", "upper", "lower"])
        while sum(map(len, out)) < size:
            part = " ".join(self.sentence() for _ in range(r.randint(2, 7)))
            if style == "wrapped":
                wide, lines = r.choice([38, 50, 66, 80]), [""]
                for w in part.split():
                    lines = [*lines[:-1], (lines[-1] + " " + w).strip()] if len(lines[-1]) + len(w) < wide else [*lines, w]
                part = "\n".join(lines)
            elif style == "chat":
                part = f"{r.choice(['## You', '## Assistant', '**Speaker 1**:', '<!-- page 3 -->'])}\n\n{part}"
            out.append({"upper": part.upper(), "lower": part.lower()}.get(style, part))
        return r.choice(["\n\n", "\n"]).join(out)

    def entry(self) -> str:
        r = self.r
        return " ".join(self.content() for _ in range(r.randint(1, 3))) if self.short else self.sentence(4, 11).rstrip(".?!") + r.choice(["", "", ";"])

    def list(self, size: int) -> str:
        r = self.r
        self.short = r.random() < 0.6
        mark = r.choice(["- ", "* ", "+ ", "• ", "1. ", "1) ", "(a) ", "[ ] ", "", "toc", "toc", "link", "count", "– "])
        if mark == "":
            self.short = True
        lines = []
        while sum(map(len, lines)) < size:
            n, e = len(lines) + 1, self.entry()
            line = {
                "toc": f"{e.capitalize()} {'.' * r.randint(4, 30)} {n * 3}", "link": f"* [{e}](pages/{n}.md)", "count": f"* {e} ({r.randint(2, 99)})",
                "1. ": f"{n}. {e}", "1) ": f"{n}) {e}", "(a) ": f"({chr(97 + n % 26)}) {e}",
            }.get(mark, mark + e)
            lines.append((" " * 4 if r.random() < 0.1 else "") + line)
        return "\n".join(lines)

    def table(self, size: int) -> str:
        r = self.r
        style = r.choice(["pipe", "pipe", "html", ",", ";", "\t", "space", "&", "bare"])
        cols, wide = r.randint(2 if style not in "," else 3, 6), style in ("pipe", "html", "&", "\t") and r.random() < 0.3
        cell = lambda: r.choice([self.content(), self.content(), f"{r.uniform(1, 999):.1f}", str(r.randint(1, 999)), ""]) if not wide else self.sentence(3, 6).rstrip(".?!,")
        rows = []
        while sum(map(len, rows)) < size:
            cells = [cell() for _ in range(cols)]
            if style == "html":
                rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
            elif style == "space":
                rows.append("".join(c[:13].ljust(16) for c in cells).rstrip() or "-")
            elif style in ("pipe", "bare"):
                rows.append(("| " if style == "pipe" else "") + " | ".join(cells) + (" |" if style == "pipe" else ""))
            elif style == "&":
                rows.append(" & ".join(cells) + " \\\\")
            else:
                rows.append(style.join((f'"{c}"' if r.random() < 0.3 else c) for c in cells).replace(", ", " "))
        if style == "pipe" and not wide:
            rows.insert(1, "|" + "---|" * cols)
        return ("<table>\n" if style == "html" else "") + "\n".join(rows)

    def junk(self, size: int) -> str:
        r = self.r
        style = r.choice(["symbols", "mash", "mix", "moji", "spaced", "again", "loop", "hex", "base", "again", "turned"])
        if style == "symbols":
            return "\n".join("".join(r.choice("!?%&/()=+*#<>[]{}|~^-_.:;'\"$@\\ ") for _ in range(r.randint(20, 70))) for _ in range(size // 45 + 1))
        if style == "mash":
            lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0159!|., ") for _ in range(r.randint(10, 70))) for _ in range(size // 40 + 1)]
            return "\n".join(lines)
        if style == "hex":
            return "\n".join(f"0x{r.getrandbits(32):08x} {r.getrandbits(8):02x} {r.getrandbits(8):02x} ?? frame@{r.randint(1, 99999)}#{i} rc=-{r.randint(0, 9)}" for i in range(size // 45 + 1))
        if style == "base":
            return "\n".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)) for _ in range(size // 64 + 1))
        if style in ("again", "loop"):
            unit = r.choice([self.sentence(2, 9), self.sentence(3, 6).rstrip(".?!,")]) if style == "again" else ""
            if style == "loop":
                two = [self.content() for _ in range(r.randint(1, 3))]
                return " ".join(r.choice([*two, r.choice(two), "..."]) for _ in range(size // 6 + 1))
            return r.choice(["\n", " ", "  ", "\r\n"]).join([unit] * (size // len(unit) + 1))
        text = " ".join(self.sentence() for _ in range(size // 70 + 1))
        if style == "spaced":
            return "  ".join(" ".join(w) for w in text.split())
        if style == "moji":
            return "".join(r.choice(["Ã©", "Ã¨", "Ã¼", "ï¿½", "�", "Â°", "â€™"]) if r.random() < 0.25 else c for c in text)
        out = []
        for w in text.split():
            letters = list(w)
            r.shuffle(letters)
            out.append("".join(letters) if style == "mix" else w[::-1])
        return " ".join(out)

    def document(self) -> tuple[str, str]:
        r = self.r
        self.lang = r.choice(list(self.common))
        self.names = r.choice([0.02, 0.02, 0.1, 0.5])  # words with a capital letter
        self.real = len(self.bank) >= 50 and r.random() < 0.8
        self.stock = [r.choice(self.corpus_words) if self.real else self.word() for _ in range(r.choice([60, 200, 600]))]
        self.small = r.choice([0.55, 0.45, 0.45, 0.35, 0.02])  # the last: telegram style
        size, kind = r.choice([90, 160, 250, 400, 700, 1100, 2500]), r.choice(["prose", "prose", *KINDS])
        other = r.choice(KINDS[1:])
        if kind == "prose":
            part = r.choice([0, 0, 0.15, 0.3, 0.5])
            main, rest = self.prose(int(size * (1 - part))), getattr(self, other)(int(size * part)) if part else ""
        else:
            part = r.choice([0, 0, 0, 0.1, 0.25])
            main, rest = getattr(self, kind)(int(size * (1 - part))), self.prose(int(size * part)) if part else ""
        title = r.choice(["", "", f"# {self.content()} {self.content()}\n", f"{self.content()} {self.content()}\n\n"])
        # a kind that fills less than two thirds of the characters is not the kind of the text
        if kind != "prose" and len(main) < 2 * (len(rest) + len(title)):
            kind = "prose"
        if kind == "prose" and len(rest) >= 2 * (len(main) + len(title)):
            kind = other
        parts = [x for x in ((main, rest) if r.random() < 0.5 else (rest, main)) if x]
        return title + "\n\n".join(parts), kind


def sentence_bank(documents: DataFrame, common: list[str], texts: int = 400, each: int = 20) -> list[str]:
    """Sentences of the corpus that the labelled texts are made of: at most ``each`` of each of ``texts`` texts, chosen by a hash.

    A sentence begins with a capital letter, ends with a mark, has six words or more and a quarter of common ones, and
    at most 250 characters. A small corpus may have none; then the labelled texts are of invented words alone.
    """
    rows = documents.filter("doc_id is not null and text is not null")
    ids = [r[0] for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(texts).collect()]
    found = F.slice(F.regexp_extract_all("text", F.lit(r"\p{Lu}[^.!?\n\r|]{30,250}[.!?](?=\s|$)"), 0), 1, each)
    listed = {w.lower() for w in common}
    out = set()
    for (sentences,) in rows.filter(F.col("doc_id").isin(ids)).select(found).collect() if ids else ():
        for s in sentences:
            words = re.findall(r"[^\W_]+", s.lower())
            if len(words) >= 6 and 4 * sum(w in listed for w in words) >= len(words):
                out.add(s)
    return sorted(out)


def labelled_texts(spark: SparkSession, common: dict[str, list[str]], documents: int = 6000, seed: int = 7, bank: list[str] = ()) -> DataFrame:
    """``doc_id, text, kind``: the labelled documents, a fixed number whatever the input's size, made by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Maker(common, seed, bank)
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                maker.r.seed(seed * 1_000_003 + i)
                rows.append(maker.document())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in zip(*rows, strict=True))], names=["doc_id", "text", "kind"])

    return spark.range(documents).selectExpr("id as doc_id").mapInArrow(run, "doc_id bigint, text string, kind string")


# --- incremental reduced-error pruning ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """If all conditions (feature, '>=' or '<', threshold) hold, the text is of the kind."""

    kind: str
    conditions: tuple[tuple[int, str, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, op, v in self.conditions:
            out &= x[:, f] >= v if op == ">=" else x[:, f] < v
        return out


def _grow(x: np.ndarray, y: np.ndarray, usable: list[int]) -> list[tuple[int, str, float]]:
    """Add the condition of the greatest information gain until no other kind is covered."""
    conditions: list[tuple[int, str, float]] = []
    while y.any() and not y.all() and len(conditions) < 6:
        p0, n0 = y.sum(), (~y).sum()
        before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        for f in usable:
            order = np.argsort(x[:, f], kind="stable")
            v, hit = x[order, f], y[order]
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            if not len(cut):
                continue
            below_p = np.cumsum(hit)[cut - 1].astype(float)
            below_n = cut - below_p
            for op, p, n in (("<", below_p, below_n), (">=", p0 - below_p, n0 - below_n)):
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - before)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (f, op, float((v[cut[i] - 1] + v[cut[i]]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        keep = Rule("", (best[1],)).holds(x)
        x, y = x[keep], y[keep]
    return conditions


def induce_rules(x: np.ndarray, kinds: np.ndarray, seed: int = 7, order: tuple[str, ...] = KINDS, least: int = 8, tries: int = 6, worth_least: float = 0.9) -> list[Rule]:
    """Incremental reduced-error pruning (Fürnkranz and Widmer 1994), kind after kind; what no rule covers is prose.

    A rule is grown on two thirds of the texts that no rule covers yet and pruned on the rest. If it covers fewer than
    ``least`` texts of the rest, or right ones do not outweigh wrong ones by ``worth_least``, another split is tried;
    after ``tries`` of these in a row the rules of that kind are complete.
    """
    rng, rules = np.random.default_rng(seed), []
    left = np.arange(len(x))
    usable = [FEATURES.index(f) for f in RULE_FEATURES]
    for kind in order:
        failed = 0
        while failed < tries and (kinds[left] == kind).any():
            mixed = rng.permutation(left)
            grow, prune = mixed[: 2 * len(mixed) // 3], mixed[2 * len(mixed) // 3 :]
            conditions = _grow(x[grow], kinds[grow] == kind, usable)

            def worth(conds: list) -> float:
                hit = Rule(kind, tuple(conds)).holds(x[prune])
                p = (kinds[prune[hit]] == kind).sum()
                return (2 * p - hit.sum()) / hit.sum() if hit.sum() >= least else -1.0  # noqa: B023

            while len(conditions) > 1 and max(worth(conditions[:i]) for i in range(1, len(conditions))) >= worth(conditions):
                conditions = max((conditions[:i] for i in range(1, len(conditions))), key=worth)
            if not conditions or worth(conditions) < worth_least:
                failed += 1
                continue
            failed = 0
            rules.append(Rule(kind, tuple(conditions)))
            left = left[~rules[-1].holds(x[left])]
    return rules


def rules_to_sql(rules: list[Rule], features: tuple[str, ...] = FEATURES) -> str:
    """The ordered rules as one CASE expression."""
    if not rules:
        return "'prose'"
    when = [" and ".join(f"{features[f]} {op} {v!r}D" for f, op, v in r.conditions) for r in rules]
    return "case " + " ".join(f"when {w} then '{r.kind}'" for w, r in zip(when, rules, strict=True)) + " else 'prose' end"


def best_rules(x: np.ndarray, kinds: np.ndarray, seed: int = 7, runs: int = 4) -> list[Rule]:
    """Of the rules of several runs, those with the fewest errors on a quarter of the texts that no run has seen."""
    mixed = np.random.default_rng(seed).permutation(len(x))
    held, seen = mixed[: len(x) // 4], mixed[len(x) // 4 :]
    found = [induce_rules(x[seen], kinds[seen], seed + k) for k in range(runs)]
    return min(found, key=lambda rules: (decide(rules, x[held]) != kinds[held]).sum())


def decide(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """The kind of each row by the first rule that holds."""
    out, left = np.full(len(x), "prose", object), np.ones(len(x), bool)
    for rule in rules:
        hit = rule.holds(x) & left
        out[hit] = rule.kind
        left &= ~hit
    return out


def learned_case(spark: SparkSession, common: dict[str, list[str]], documents: int = 6000, seed: int = 7, bank: list[str] = ()) -> str:
    """Train on ``documents`` labelled texts and return the CASE expression."""
    texts = labelled_texts(spark, common, documents, seed, bank)
    words = [w for ws in common.values() for w in ws]
    rows = sorted(text_statistics(texts, words, ("kind",)).select("doc_id", *FEATURES, "kind").collect())
    x = np.array([[float(v) for v in r[1:-1]] for r in rows])
    return rules_to_sql(best_rules(x, np.array([r[-1] for r in rows]), seed))


def common_by_language(common: DataFrame, most: int = 20_000) -> dict[str, list[str]]:
    """The common words of each language; more than ``most`` raise ValueError, since every task holds them."""
    rows = common.select("lang", "word").filter("word is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    out: dict[str, list[str]] = {}
    for lang, word in sorted((r[0] or "", r[1]) for r in rows):
        out.setdefault(lang, []).append(word)
    return out


def text_kinds(documents: DataFrame, common: DataFrame, labelled: int = 6000, seed: int = 7) -> DataFrame:
    """Per document the statistics and ``kind``: prose, list, table or junk.

    Input: ``doc_id, text`` and ``lang, word``. Rows with a null doc_id are passed over; a null or blank text is
    prose of no words; a repeated row gives a repeated row; an empty table gives no row; further columns are ignored.
    """
    words = common_by_language(common)
    case = learned_case(documents.sparkSession, words, labelled, seed, sentence_bank(documents, [w for ws in words.values() for w in ws]))
    stats = text_statistics(documents.filter("doc_id is not null"), [w for ws in words.values() for w in ws])
    return stats.withColumn("kind", F.when(F.col("words") + F.col("symbol_ratio") == 0, F.lit("prose")).otherwise(F.expr(case)))
