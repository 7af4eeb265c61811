"""Repair of text from scanned pages.

Running headers and footers are lines at page edges that come back, up to wrong letters, on neighbouring pages of a
file; page numbers are numbers at page edges that run along with the pages. Words broken at line ends are joined by the
vocabulary of the whole corpus, which also tells which rare word is a frequent one with wrongly recognised letters:
both have one skeleton, a spelling in strokes that does not change when letters are confused.

Pages are read twice in Python: once for their edges, their broken line ends and counted words, once for the lines that
hold words which are not known to be right. Texts never cross the network, only edges, counts and findings do.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.session import written_table

#: Signs that recognition confuses, as strokes; the second table has confusions that exclude the first.
STROKES = {"1": "i", "l": "i", "i": "i", "!": "i", "|": "i", "r": "i", "j": "i", "t": "t", "f": "t", "7": "t", "e": "c", "c": "c", "a": "o", "o": "o", "0": "o", "4": "o", "b": "b", "h": "b", "6": "b", "8": "b", "g": "g", "9": "g", "q": "g", "s": "s", "5": "s", "d": "ci", "m": "iii", "n": "ii", "u": "ii", "w": "vv", "y": "v", "z": "z", "2": "z"}
OTHER_STROKES = STROKES | {"d": "o", "h": "ii", "é": "b", "è": "b"}
_TABLES = (str.maketrans(STROKES), str.maketrans(OTHER_STROKES))
_MARKS = re.compile("[̀-ͯ]+")

#: Signs that break a word at a line end: hyphens, soft hyphen, not sign, dash.
BREAKS = "-‐‑­¬–"
_WORD = r"[^\W_]+(?:[!|](?=[^\W\d_])[^\W_]+|['’-][^\W_]+)*"
TOKEN = re.compile(_WORD)
ENDS_BROKEN = re.compile(rf"({_WORD})([{BREAKS}])$")
EDGE = 4  # lines at each edge of a page that are looked at first; deeper ones follow where all of these are furniture
DEEPER = 8  # so many times deeper the next look goes, until a line that stays is met
NEAR, CLOSE = 12, 3  # pages before and after a page that are its neighbours, and its close neighbours
BLOCK = 96  # page numbers of one file that are judged together, with the pages around them
CROWD = 1000  # a block of more pages than that (without numbers, or numbered alike) is judged in parts

_NUMBER = r"(?:[0-9lIiOoSB|]{1,4}|[ivxlcIVXLC]{1,7})"
ALONE = re.compile(rf"^[\W_]*(?:(?:page|seite|página|pagina|pag|pág|blatt|folio|p|s|f)\b\.?)?[\W_]*({_NUMBER})(?:\s*(?:/|\||of|von|de|sur)\s*[0-9lIOoSB]{{1,4}})?[\W_]*$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_DIGITS = str.maketrans("lIi|OoSB", "11110058")


_NO_SIGN = re.compile(r"[\W_]+")


def _ascii_strokes(table: dict[str, str]) -> tuple[bytes, bytes, list[tuple[str, str]]]:
    """The same table for ASCII: signs of one stroke, signs that count for nothing, and signs of several strokes."""
    one = {ord(k): v for k, v in table.items() if len(v) == 1 and k.isascii()}
    gone = bytes(c for c in range(128) if not chr(c).isalnum() and c not in one)
    return bytes(ord(one.get(c, chr(c))) if c < 128 else c for c in range(256)), gone, [(k, v) for k, v in table.items() if len(v) > 1]


_ASCII = (_ascii_strokes(STROKES), _ascii_strokes(OTHER_STROKES))


def skeleton(text: str, table: int = 0) -> str:
    """The strokes of a text without spaces, marks, accents and case; equal for texts that differ in confused letters."""
    low = text.lower()
    if not low.isascii():
        if table and ("é" in low or "è" in low):
            low = low.translate(_TABLES[1])
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
        if not low.isascii():
            return _NO_SIGN.sub("", low.translate(_TABLES[table]))
    one, gone, several = _ASCII[table]
    out = low.encode().translate(one, gone).decode()
    for sign, strokes in several:
        if sign in out:
            out = out.replace(sign, strokes)
    return out


def number_of(text: str) -> int | None:
    """The page number that a text consists of, wrongly recognised digits put right; roman numerals count."""
    text = text.strip()
    m = ALONE.match(text) if len(text) < 40 else None
    if not m:
        return None
    sign = m[1]
    if any(c.isdigit() for c in sign):
        return int(sign.translate(_DIGITS))
    low = sign.lower()
    if not set(low) <= set(_ROMAN):
        return int(sign.translate(_DIGITS)) if re.search("[OoSB|]", sign) and len(sign) > 1 and set(sign) <= set("lIi|OoSB") else None
    total = 0
    for a, b in zip(low, [*low[1:], ""], strict=True):
        total += -_ROMAN[a] if b and _ROMAN[b] > _ROMAN[a] else _ROMAN[a]
    return total


def edge_line(text: str) -> tuple[str, int | None, bool]:
    """Skeleton without page number, page number, and whether the line is nothing but a number."""
    alone = number_of(text)
    if alone is not None:
        return "", alone, True
    parts = [p for p in re.split(r"\s{2,}|\t+", text.strip()) if p] if "  " in text or "\t" in text else ()
    if len(parts) > 1:
        for at in (0, len(parts) - 1):
            n = number_of(parts[at])
            if n is not None and (any(c.isdigit() for c in parts[at]) or len(parts) == 2):
                return skeleton("".join(parts[:at] + parts[at + 1 :])), n, False
    return skeleton(text), None, False


def interrupts(lines: list[str], full: list[int], k: int, top: bool) -> bool:
    """Whether a line set off by a blank one stands in the middle of a sentence that goes on to, or comes from, another page."""
    text = lines[full[k]].strip()
    if not text[:1].isupper() or text[-1] in ".!?,;:…" or text[-1] in BREAKS:
        return False
    if top:
        return k + 1 < len(full) and full[k + 1] > full[k] + 1 and lines[full[k + 1]].lstrip()[:1].islower()
    return k > 0 and full[k - 1] < full[k] - 1 and lines[full[k - 1]].rstrip()[-1] not in ".!?:…\"'”»)|"


def broken_end(line: str) -> re.Match | None:
    """The half word and the sign with which a line ends."""
    bare = line.rstrip()
    return ENDS_BROKEN.search(bare, max(0, bare.rfind(" "), bare.rfind("\t"))) if bare[-1:] in BREAKS else None


def page_lines(content: str | None) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in content.split("\n")] if content else []


#: What is known of an edge line, as bits.
ALONE_BIT, HEADING, INTERRUPTS, CAPITALS, TIGHT, SPACED, SENTENCE = 1, 2, 4, 8, 16, 32, 64

#: One row per page (its edges and broken ends packed into texts that only ``_decide`` reads) or per counted word.
_FACTS = "output_file string, page_no int, page_id bigint, lang string, edges string, ends string, word string, n bigint"
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
_INTS, _TEXTS = pa.list_(pa.int32()), pa.list_(pa.string())


def _batch(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.strip().split(" ")[0] for x in names.split(", ")])


def _edge(lines: list[str], full: list[int], k: int, top: bool) -> str:
    """An edge line in one text: its number, bits, page number, first word and skeleton."""
    i = full[k]
    text = lines[i].strip()
    if text[0] == "#":
        return f"{i + 1}\t{HEADING}\t\t{_first_word(text)}\t"
    key, number, alone = edge_line(text)
    bits = ALONE_BIT if alone else 0
    if text[-1] in ".,;:?!" or text[-1] in BREAKS:
        bits |= SENTENCE
    elif interrupts(lines, full, k, top):
        bits |= INTERRUPTS
    if text.isupper():
        bits |= CAPITALS
    if i + 1 < len(lines) and lines[i + 1] and not lines[i + 1].isspace():
        bits |= TIGHT
    if "  " in text:
        bits |= SPACED
    return f"{i + 1}\t{bits}\t{'' if number is None else number}\t{_first_word(text) if top else ''}\t{key}"


def _first_word(line: str) -> str:
    m = TOKEN.search(line)
    return m[0].lower() if m else ""


def _facts(depth: int, count: bool):
    """One pass over the pages: what stands at their edges, their broken line ends, and counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter[str]] = defaultdict(Counter)
        for b in batches:
            rows = []
            for file, no, page, lang, content in zip(*(b.column(c).to_pylist() for c in ("output_file", "page_no", "page_id", "lang", "content")), strict=True):
                lines = page_lines(content)
                full = [i for i, x in enumerate(lines) if x and not x.isspace()]
                if not full:
                    continue
                last = len(full) - 1
                most = min(depth, last + 1)
                tops = [_edge(lines, full, k, True) for k in range(most)]
                if last >= most:  # the first line beyond: it stays whatever comes before it
                    tops.append(f"{full[most] + 1}\t{HEADING}\t\t{_first_word(lines[full[most]])}\t")
                bottoms = [_edge(lines, full, last - k, False) for k in range(most)]
                ends = []
                # words that may be halves are not counted: those broken at line ends, and a small first one of the page
                halves = {(full[0], 0)} if lines[full[0]].lstrip()[0].islower() else set()
                for k, i in enumerate(full):
                    bare = lines[i].rstrip()
                    if bare[-1] in BREAKS and (m := broken_end(bare)):
                        # what lies below the last line of text at the lower edge may be furniture
                        after = full[k + 1 :] if k + 1 > last - depth else full[k + 1 : k + 2]
                        ends.append("\t".join((str(i + 1), m[1].lower(), m[2], *(f"{j + 1} {_first_word(lines[j])}" for j in after))))
                        halves.add((i, len(bare.split()) - 1))
                        if k < last:
                            halves.add((full[k + 1], 0))
                if count:
                    own = words[lang]
                    own.update(content.split())
                    for i, k in halves:
                        own[lines[i].split()[k]] -= 1
                rows.append((file, no, page, lang, "\n".join(tops) + "\n\n" + "\n".join(bottoms), "\n".join(ends), None, None))
            yield _batch(rows, _FACTS, _KINDS)
            if sum(map(len, words.values())) > 300_000:
                yield _counted(words)
                words.clear()
        yield _counted(words)

    return run


def _counted(words: dict[str | None, Counter]) -> pa.RecordBatch:
    """Counts of words from counts of what stands between spaces (no word reaches over a space)."""
    low: Counter[tuple] = Counter()
    for lang, own in words.items():
        for chunk, n in own.items():
            if n > 0:
                for w in TOKEN.findall(chunk):
                    low[(lang, w.lower())] += n
    return _batch([(None, None, None, lang, None, None, w, n) for (lang, w), n in low.items()], _FACTS, _KINDS)


def _language(pages: DataFrame) -> F.Column:
    """The first two letters of a page's language, null if it has none."""
    return F.nullif(F.substring(F.lower(F.trim("ocr_lang")), 1, 2), F.lit("")) if "ocr_lang" in pages.columns else F.lit(None).cast("string")


def page_facts(pages: DataFrame, depth: int = EDGE, count: bool = True) -> DataFrame:
    """What one pass over the pages finds: rows per page, and (if asked for) rows per language and word."""
    rows = pages.filter("page_id is not null and output_file is not null and content is not null")
    rows = rows.select("output_file", F.coalesce(F.col("page_no").cast("int"), F.lit(0)).alias("page_no"), F.col("page_id").cast("bigint").alias("page_id"), _language(pages).alias("lang"), "content")
    return rows.mapInArrow(_facts(depth, count), _FACTS)


# --- furniture -------------------------------------------------------------------------------------------------------

_DECIDED = (
    "output_file string, block bigint, page_no int, page_id bigint, lang string, furniture array<int>, deep boolean, opens boolean, head_line int, head_word string, "
    "line_no array<int>, left array<string>, sign array<string>, next_page array<bigint>, next_line array<int>, right array<string>"
)
_DECIDED_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), _INTS, pa.bool_(), pa.bool_(), pa.int32(), pa.string(), _INTS, _TEXTS, _TEXTS, pa.list_(pa.int64()), _INTS, _TEXTS]


def _distance(a: str, b: str) -> int:
    """Edit distance, one column of the table at a time as bits of a number (Hyyrö 2003)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, out = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = full, 0
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & more) + more) ^ more | same | less) & full
        up, down = less | ~(diagonal | more) & full, diagonal & more
        out += (up & top > 0) - (down & top > 0)
        up, down = up << 1 | 1, down << 1
        more, less = (down | ~(diagonal | up)) & full, up & diagonal & full
    return out


@lru_cache(maxsize=4096)
def _threes(text: str) -> frozenset:
    return frozenset(map("".join, zip(text, text[1:], text[2:], strict=False)))


def _alike(key: str, running: list[str], alike: float) -> bool:
    near = [r for r in running if abs(len(r) - len(key)) <= alike * len(r)]
    if not near:
        return False
    own = _threes(key)
    # each edit destroys three runs of three at most, so texts that are alike share many
    return any(len(_threes(r) - own) <= 3 * alike * len(r) and _distance(r, key) <= alike * len(r) for r in near)


class Neighbourhood:
    """Pages of one file in order of their numbers, and what comes back at their edges."""

    def __init__(self, rows: list[tuple], share: float, alike: float):
        self.share, self.alike = share, alike
        once: dict[int, tuple] = {}
        for row in rows:
            once.setdefault(row[4], row)
        self.rows = list(once.values())
        self.edges = [tuple([self._line(x) for x in zone.split("\n")] for zone in row[6].split("\n\n")) for row in self.rows]
        self.numbers = [row[3] for row in self.rows]
        # page numbers where a skeleton, a form or a step between number and page stands, by edge
        self.keys = (defaultdict(list), defaultdict(list))
        self.forms: tuple[list, list] = ([], [])
        self.steps: dict[int, list] = defaultdict(list)
        for no, zones in zip(self.numbers, self.edges, strict=True):
            for step in {line[2] - no for zone in zones for line in zone if line[2] is not None}:
                self.steps[step].append(no)
        for no, zones in zip(self.numbers, self.edges, strict=True):
            for at, zone in enumerate(zones):
                for key in {line[4] for line in zone if len(line[4]) >= 3}:
                    self.keys[at][key].append(no)
                if any(self._form(zone, k, no) for k in range(len(zone))):
                    self.forms[at].append(no)
        self.often = tuple([k for k, at in zone.items() if len(at) >= 2] for zone in self.keys)
        upper = Counter(line[4] for zones in self.edges for line in zones[0] if line[1] & CAPITALS)
        self.capitals = any(2 * upper[k] > len(self.keys[0][k]) for k in self.often[0] if self.repeated(self.keys[0][k], self.numbers[0], False))

    @staticmethod
    def _line(text: str) -> tuple[int, int, int | None, str, str]:
        no, bits, number, word, key = text.split("\t")
        return int(no), int(bits), int(number) if number else None, word, key

    @staticmethod
    def _within(places: list[int], no: int, reach: int) -> int:
        return bisect_right(places, no + reach) - bisect_left(places, no - reach)

    def repeated(self, places: list[int], no: int, sentence: bool) -> bool:
        """Whether enough of the neighbours of a page have it as well: a share of them, or three of the close ones."""
        k = self._within(places, no, NEAR)
        if k < (3 if sentence else 2):
            return False
        return k >= (0.5 if sentence else self.share) * self._within(self.numbers, no, NEAR) or (not sentence and self._within(places, no, CLOSE) >= 3)

    def in_step(self, line: tuple, no: int) -> bool:
        return line[2] is not None and self._within(self.steps[line[2] - no], no, NEAR) >= 2

    def _form(self, zone: list, k: int, no: int) -> bool:
        """A line that interrupts a sentence, or the outermost one, beside a running number."""
        if zone[k][1] & (HEADING | ALONE_BIT | SENTENCE):
            return False
        return bool(zone[k][1] & INTERRUPTS) or (k == 0 and len(zone) > 1 and bool(zone[1][1] & ALONE_BIT) and self.in_step(zone[1], no))

    def furniture(self, i: int) -> tuple[set[int], bool]:
        """The furniture lines of a page, and whether there may be more than the lines that were looked at."""
        no, out, deep = self.numbers[i], set(), False
        top, bottom = self.edges[i]
        for at, zone in ((0, top), (1, bottom)):
            hits = []
            for k, line in enumerate(zone):
                _, bits, _, _, key = line
                if bits & HEADING:
                    break
                hit = self.in_step(line, no)
                if not hit and not bits & ALONE_BIT:
                    sentence = bool(bits & SENTENCE)
                    hit = len(key) >= 3 and self.repeated(self.keys[at][key], no, sentence)
                    if not hit and not sentence:
                        hit = self._form(zone, k, no) and self.repeated(self.forms[at], no, False)
                        hit = hit or len(key) >= 6 and _alike(key, [r for r in self.often[at] if len(r) >= 6 and self.repeated(self.keys[at][r], no, False)], self.alike)
                if not hit:
                    break
                hits.append(line)
            # the upper edge ends with the line beyond those looked at, if there is one
            deep = deep or len(hits) == len(bottom) < len(top)
            if at == 0 and i == 0 and no <= 1:
                named = [h for h in hits if not h[1] & ALONE_BIT and h[2] is None and not (h[1] & CAPITALS and self.capitals) and not h[1] & (TIGHT | SPACED)]
                if named:
                    hits.remove(named[-1])
            out.update(h[0] for h in hits)
        return out, deep


def _judged(rows: list[tuple], share: float, alike: float) -> list[tuple]:
    """The findings of the own pages of one block."""
    near = Neighbourhood(rows, share, alike)
    spoken = Counter(row[5] for row in near.rows if row[5])
    lang = max(spoken, key=lambda k: (spoken[k], k)) if spoken else None
    decided = [near.furniture(i) for i in range(len(near.rows))]
    heads = [next(((line[0], line[3]) for line in zones[0] if line[0] not in gone), None) for zones, (gone, _) in zip(near.edges, decided, strict=True)]
    out, opens = [], False
    for i, (file, block, own, no, page, code, _, packed) in enumerate(near.rows):
        if not own:
            continue
        gone, deep = decided[i]
        ends = []
        for end in packed.split("\n") if packed else ():
            at, left, sign, *after = end.split("\t")
            if int(at) in gone:
                continue
            follow = next(((page, int(j), w) for j, _, w in (x.partition(" ") for x in after) if int(j) not in gone), None)
            if follow is None:
                k = next((k for k in range(i + 1, len(heads)) if heads[k] and near.numbers[k] <= no + NEAR), None)
                follow = (near.rows[k][4], *heads[k]) if k is not None else (None, None, None)
            ends.append((int(at), left, sign, *follow))
        first = heads[i] is not None and not opens
        opens = opens or first
        out.append((file, block, no, page, code or lang, sorted(gone), deep, first, *(heads[i] or (None, None)), *(map(list, zip(*ends, strict=True)) if ends else ([], [], [], [], [], []))))
    return out


def _decide(share: float, alike: float):
    names = ("output_file", "block", "own", "page_no", "page_id", "lang", "edges", "ends", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, rows = None, []
        for b in batches:
            for *row, part in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if (row[0], row[1], part) != key:
                    if held:
                        rows += _judged(held, share, alike)
                    key, held = (row[0], row[1], part), []
                    if len(rows) > 2000:
                        yield _batch(rows, _DECIDED, _DECIDED_KINDS)
                        rows = []
                held.append(row)
        if held:
            rows += _judged(held, share, alike)
        yield _batch(rows, _DECIDED, _DECIDED_KINDS)

    return run


def _block() -> F.Column:
    return F.greatest(F.floor(F.coalesce(F.col("page_no").cast("int"), F.lit(0)) / BLOCK), F.lit(0))


def _decided(facts: DataFrame, share: float, alike: float) -> DataFrame:
    """One row per page from one look at its edges."""
    pages = facts.filter("page_id is not null").select("output_file", "page_no", "page_id", "lang", "edges", "ends", _block().alias("own_block"))
    crowds = pages.groupBy("output_file", F.col("own_block").alias("block")).count().filter(f"count > {CROWD}").select("output_file", "block", F.ceil(F.col("count") / CROWD).alias("parts"))
    # pages near the border of a block are shown to the next one too
    at = F.col("page_no") - F.col("own_block") * BLOCK
    shown = F.array_compact(F.array("own_block", F.when((at < 2 * NEAR) & (F.col("own_block") > 0), F.col("own_block") - 1), F.when(at >= BLOCK - NEAR, F.col("own_block") + 1)))
    rows = pages.withColumn("block", F.explode(shown)).withColumn("own", F.expr("block = own_block")).withColumn("ends", F.when(F.col("own"), F.col("ends"))).drop("own_block")
    rows = rows.join(crowds, ["output_file", "block"], "left").withColumn("part", F.expr("pmod(xxhash64(page_id), coalesce(parts, 1L))")).drop("parts")
    rows = rows.repartition("output_file", "block", "part").sortWithinPartitions("output_file", "block", "part", "page_no", "page_id")
    return rows.mapInArrow(_decide(share, alike), _DECIDED)


def decided_pages(pages: DataFrame, facts: DataFrame, share: float = 0.2, alike: float = 0.25) -> DataFrame:
    """Every page with its furniture, its first line of text and its broken line ends.

    Neighbours of a page are the pages of its file whose numbers differ by at most NEAR. A line at a page edge is
    furniture if its skeleton stands at the same edge of at least two and ``share`` of the neighbours (the page itself
    counts), or of three of those within CLOSE pages; one that ends like a sentence needs half of the neighbours and
    three. A skeleton that differs from such a one by at most ``alike`` of its length counts too. So does a form that
    comes back in the same way: lines that interrupt a sentence at that edge, or stand beside a running number. A
    number is furniture if one of the neighbours has a number in step with it. What lies further in is furniture only
    if all lines nearer to the edge are, however many there are: pages of which all lines looked at are furniture are
    looked at again, deeper. On the first page the last line that looks like a running header is the title, which
    stands in the text, if it is set off by a blank line and not in capitals like the running header.

    Blocks of BLOCK page numbers are judged at once, with the pages around them, so no task holds a whole file; of
    more than CROWD pages with such numbers (missing or equal ones) each is judged among a share of them.
    """
    decided = written_table(_decided(facts, share, alike))
    depth = EDGE
    while not (deep := decided.filter("deep")).isEmpty():
        depth *= DEEPER
        keys = deep.select("output_file", "block").distinct()
        around = keys.select("output_file", F.explode(F.expr("sequence(block - 1, block + 1)")).alias("b")).distinct()
        # few blocks go to all tasks, so that no text is shuffled; if they are many, the join sorts
        around = F.broadcast(around) if around.count() <= 100_000 else around
        numbered = pages.withColumn("b", _block())
        again = _decided(page_facts(numbered.join(around, ["output_file", "b"], "left_semi").drop("b"), depth, False), share, alike)
        again = again.join(keys, ["output_file", "block"], "left_semi")
        decided = written_table(decided.join(keys, ["output_file", "block"], "left_anti").unionByName(again))
    return decided


# --- words -----------------------------------------------------------------------------------------------------------


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column("word").to_pylist()
        keys = [sorted({"0" + skeleton(w, 0), "1" + skeleton(w, 1)}) for w in words]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("word"), b.column("n"), pa.array(keys, pa.list_(pa.string()))], names=["lang", "word", "n", "keys"])


def vocabulary(facts: DataFrame) -> DataFrame:
    """``lang, word, n``: all words of the corpus in lower case by language, except those that may be halves of broken ones.

    Not counted are words broken at line ends and a first word of a page in small letters. Words of pages without a
    language count in each (codes have two letters, so there are few); without any language all are in one group.
    """
    own = facts.filter("word is not null").select("lang", "word", "n")
    codes = sorted(r[0] for r in facts.filter("page_id is not null and lang is not null").select("lang").distinct().collect())
    every = F.explode(F.when(F.col("lang").isNull(), F.array(*map(F.lit, codes))).otherwise(F.array("lang"))) if codes else F.lit("")
    return own.withColumn("lang", every).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def misread_words(words: DataFrame, ratio: int = 8) -> DataFrame:
    """``lang, word, right``: words with wrongly recognised letters and what they should be (null if that is not known).

    A word is misread if another word of its language and of the same skeleton is at least ``ratio`` times as frequent
    (three times, for words of five letters or more that occur once or twice), or if it has four letters or more and
    single digits or bars before letters (``qu1et``, ``7own``; not ``mp3``, ``300dpi``, ``1080p``).
    """
    spelled = words.filter(r"length(word) >= 2 and word rlike '\\p{L}'")
    keyed = spelled.mapInArrow(_skeletons, "lang string, word string, n bigint, keys array<string>").select("lang", "word", "n", F.explode("keys").alias("key"))
    clean = F.when(~F.col("word").rlike(r"[\p{N}!|]"), F.struct("n", "word"))
    pairs = keyed.withColumn("top", F.max(clean).over(Window.partitionBy("lang", "key"))).filter("top.word != word")
    # accents and hyphens are no letters that were confused
    plain = lambda c: F.translate(c, "áàâäéèêëíìîïóòôöúùûüñç-", "aaaaeeeeiiiioooouuuunc")
    pairs = pairs.filter(f"n * {ratio} <= top.n or (n <= 2 and n * 3 <= top.n and length(word) >= 5)").filter(plain("top.word") != plain("word"))
    mixed = spelled.filter(r"word rlike '[\\p{N}!|]\\p{L}' and not word rlike '[\\p{N}!|]{2}' and length(regexp_replace(word, '[^\\p{L}]+', '')) >= 4")
    both = pairs.select("lang", "word", "top").unionByName(mixed.select("lang", "word", F.lit(None).cast("struct<n:bigint,word:string>").alias("top")))
    return both.groupBy("lang", "word").agg(F.max("top").alias("top")).select("lang", "word", F.col("top.word").alias("right"))


_LINES = "page_id bigint, line_no int, word string, first boolean"


def _doubtful(trusted: dict[str, frozenset]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what stands between spaces and holds trusted words alone; texts repeat such chunks, so few are looked at
        clean: dict[str, set[str]] = defaultdict(set)
        for b in batches:
            pages, nos, words, first = [], [], [], []
            for page, lang, content in zip(*(b.column(c).to_pylist() for c in ("page_id", "lang", "content")), strict=True):
                known = lang if lang in trusted else ""
                right, fine = trusted[known], clean[known]
                new = set(content.split()) - fine
                good = {c for c in new if right.issuperset(TOKEN.findall(c))}
                if len(fine) > 500_000:
                    fine.clear()
                fine |= good
                odd = new - good
                if not odd:
                    continue
                before = ""
                for i, line in enumerate(page_lines(content)):
                    parts = line.split()
                    if not odd.isdisjoint(parts):
                        found = TOKEN.findall(line)
                        was, broken = broken_end(before), broken_end(line)
                        for k, w in enumerate(found):
                            if w not in right and not (k == 0 and was) and not (broken and k == len(found) - 1):
                                pages.append(page)
                                nos.append(i + 1)
                                words.append(w.lower())
                                first.append(k == 0)
                    if parts:
                        before = line
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(nos, pa.int32()), pa.array(words, pa.string()), pa.array(first, pa.bool_())], names=["page_id", "line_no", "word", "first"])

    return run


def broken_words(decided: DataFrame, overall: DataFrame) -> DataFrame:
    """Words broken at line ends: ``page_id, lang, line_no, left, sign, next_page, next_line, right, joined, split``.

    The other half is the first word of the next line that is no furniture, if need be on the next page with text.
    ``split`` is false where the corpus has the two halves only as a compound with its own hyphen, or more often so.
    ``overall``: ``word, n``.
    """
    ends = decided.select("output_file", "block", "page_id", "lang", F.inline(F.arrays_zip("line_no", "left", "sign", "next_page", "next_line", "right")))
    # ends whose next page lies in another block: one row per block tells where that begins
    starts = decided.filter("opens").select("output_file", "block", F.struct("page_id", F.col("head_line").alias("line"), F.col("head_word").alias("word")).alias("h"))
    follow = starts.groupBy("output_file", "block").agg(F.min("h").alias("h"))
    follow = follow.select("output_file", "block", F.lead("h").over(Window.partitionBy("output_file").orderBy("block")).alias("over")).filter("over is not null")
    far = ends.filter("next_page is null").join(follow, ["output_file", "block"], "left")
    far = far.withColumns({"next_page": F.col("over.page_id"), "next_line": F.col("over.line"), "right": F.col("over.word")}).drop("over")
    ends = ends.filter("next_page is not null").unionByName(far).drop("output_file", "block")
    ends = ends.withColumn("joined", F.concat("left", "right")).withColumn("compound", F.concat_ws("-", "left", "right"))
    ends = ends.join(overall.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
    compounds = overall.filter("contains(word, '-')").select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    ends = ends.join(compounds, "compound", "left").drop("compound")
    seen = F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_compound", F.lit(0))
    return ends.withColumn("split", F.when(F.col("sign") == "–", F.coalesce(F.col("n_joined"), F.lit(0)) > 0).otherwise(seen))


def repaired_lines(pages: DataFrame, trusted_words: int = 50_000) -> dict[str, DataFrame]:
    """The findings over all pages: furniture, broken words, misread words and the lines that have them.

    Input: ``page_id, output_file, page_no, content``. Rows with a null page_id, output_file or content have no
    lines; a page delivered twice counts once; a missing page_no is 0. Lines end with a line feed, a carriage return
    before it belongs to the end. The ``trusted_words`` most frequent right words are held by every task to pass
    over most words quickly; all others are looked up by a join, so the result does not depend on the number.
    """
    facts = written_table(page_facts(pages))
    decided = decided_pages(pages, facts)
    furniture = decided.select("page_id", F.explode("furniture").alias("line_no"))
    words = written_table(vocabulary(facts))
    misread = written_table(misread_words(words))
    top = words.join(misread, ["lang", "word"], "left_anti").orderBy(F.desc("n"), "lang", "word").limit(trusted_words).collect()
    right: dict[str, set[str]] = defaultdict(set)
    for r in top:
        right[r["lang"]].update((r["word"], r["word"].capitalize(), r["word"].upper()))
    # a page without a language gets that of its neighbours later; until then only words pass that no language has as misread
    overall = written_table(words.groupBy("word").agg(F.sum("n").alias("n")))
    safe = overall.join(misread.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(trusted_words).collect()
    trusted = {k: frozenset(v) for k, v in right.items()} | {"": frozenset(x for r in safe for x in (r[0], r[0].capitalize(), r[0].upper()))}
    broken = written_table(broken_words(decided, overall))
    rows = pages.filter("page_id is not null and content is not null and output_file is not null").select(F.col("page_id").cast("bigint").alias("page_id"), _language(pages).alias("lang"), "content")
    spoken = decided.select("page_id", F.coalesce("lang", F.lit("")).alias("lang"))
    doubtful = rows.mapInArrow(_doubtful(trusted), _LINES).join(spoken, "page_id").join(misread, ["lang", "word"])
    # the first word of a line can be the second half of a broken one
    targets = broken.filter("split").select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), F.lit(True).alias("second"))
    doubtful = doubtful.join(targets, ["page_id", "line_no"], "left").filter("not first or second is null")
    whole = broken.filter("split").withColumn("lang", F.coalesce("lang", F.lit(""))).join(misread.withColumnRenamed("word", "joined").withColumnRenamed("right", "meant"), ["lang", "joined"])
    starts = F.expr("coalesce(startswith(meant, left), false)")
    stops = F.expr("coalesce(endswith(meant, right), false)")
    place = F.when(starts & ~stops, F.array(F.struct(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no")))).otherwise(F.array(F.struct("page_id", "line_no")))
    halves = whole.select(F.inline(place))
    wrong = doubtful.select("page_id", "line_no").unionByName(halves).distinct().join(furniture, ["page_id", "line_no"], "left_anti")
    return {"decided": decided, "furniture": furniture, "broken": broken, "misread": misread, "wrong": wrong, "wrong_words": doubtful.filter("right is not null").select("page_id", "line_no", "word", "right")}


def line_findings(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, kind``: furniture, split and misread lines."""
    found = repaired_lines(pages)
    return (
        found["furniture"].distinct().withColumn("kind", F.lit("furniture"))
        .unionByName(found["broken"].filter("split").select("page_id", "line_no").distinct().withColumn("kind", F.lit("split")))
        .unionByName(found["wrong"].withColumn("kind", F.lit("misread")))
    )


# --- paragraphs ------------------------------------------------------------------------------------------------------

_PARAGRAPHS = "output_file string, page_no int, page_id bigint, no int, of int, heading boolean, runs_on boolean, glue boolean, text string"
_PARAGRAPH_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
_OWN_LINE = re.compile(r"\s*(?:#{1,6}\s|[-*+•]\s|\d+[.)]\s|\|)")
_ENDED = re.compile(r"[.!?:…][\"'”»)\]]*$")


def corrected(line: str, fixes: dict[str, str]) -> str:
    """The line with its misread words put right, in the case that they have."""

    def put(m: re.Match) -> str:
        right = fixes.get(m[0].lower())
        if not right:
            return m[0]
        letters = [c for c in m[0] if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return right.upper()
        return right.capitalize() if m[0][0].isupper() or (m[0][0].isdigit() and len(letters) > 0 and letters[0].isupper()) else right

    return TOKEN.sub(put, line) if fixes else line


def page_paragraphs(content: str, furniture: set[int], splits: set[int], fixes: dict[int, dict[str, str]]) -> list[tuple[str, bool, bool, bool]]:
    """Paragraphs of one page: text, whether it is a heading, runs on to the next page, and is glued to what follows."""
    out: list[list] = []
    open_ = False
    for no, line in enumerate(page_lines(content), 1):
        if no in furniture:
            continue
        text = " ".join(line.split())
        if not text:
            open_ = False
            continue
        own = _OWN_LINE.match(text) is not None
        text = corrected(text, fixes.get(no, {}))
        glue = broken_end(text) is not None
        if glue and no in splits:
            text = text[:-1]
        if open_ and not own:
            out[-1][0] += ("" if out[-1][2] else " ") + text
        else:
            out.append([text, text.startswith("#"), False])
        out[-1][2] = glue
        open_ = not out[-1][1]
    return [(t, heading, not heading and (glue or not _ENDED.search(t)), glue) for t, heading, glue in out]


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for file, no, page, content, furniture, splits, fixed in zip(*(b.column(c).to_pylist() for c in ("output_file", "page_no", "page_id", "content", "furniture", "splits", "fixes")), strict=True):
            fixes: dict[int, dict[str, str]] = {}
            for x in fixed or ():
                fixes.setdefault(x["line_no"], {})[x["word"]] = x["right"]
            parts = page_paragraphs(content, set(furniture or ()), set(splits or ()), fixes)
            rows += [(file, no, page, k, len(parts), heading, runs, glue, text) for k, (text, heading, runs, glue) in enumerate(parts, 1)]
        yield _batch(rows, _PARAGRAPHS, _PARAGRAPH_KINDS)


def repaired_paragraphs(pages: DataFrame, block: int = 256, part_pages: int = 64) -> DataFrame:
    """``output_file, first_page, first_page_id, no, part, pages, text``: continuous paragraphs, without furniture, words whole and put right.

    A paragraph that a page ends in the middle of goes on with the first one of the next page. Headings, list entries
    and rows of tables stay lines of their own. Rows are in the order of first_page, first_page_id, no and part. Pages of
    one file are joined over blocks of ``block`` page numbers, and a paragraph that runs over more than ``part_pages``
    pages (text that never ends a sentence) comes in parts of so many, so no task holds all pages of a file.
    """
    found = repaired_lines(pages)
    fixes = found["wrong_words"].groupBy("page_id").agg(F.collect_set(F.struct("line_no", "word", "right")).alias("fixes"))
    splits = found["broken"].filter("split").groupBy("page_id").agg(F.collect_set("line_no").alias("splits"))
    known = found["decided"].select("page_id", "furniture").dropDuplicates(["page_id"])
    rows = pages.filter("page_id is not null and output_file is not null and content is not null")
    rows = rows.select("output_file", F.coalesce(F.col("page_no").cast("int"), F.lit(0)).alias("page_no"), F.col("page_id").cast("bigint").alias("page_id"), "content").dropDuplicates(["page_id"])
    rows = rows.join(known, "page_id", "left").join(splits, "page_id", "left").join(fixes, "page_id", "left")
    parts = written_table(rows.mapInArrow(_paragraphs, _PARAGRAPHS))

    key = F.struct("page_no", "page_id", "no")
    page = parts.groupBy("output_file", "page_no", "page_id").agg(F.max("of").alias("of"), F.bool_or(F.expr("no = 1 and heading")).alias("heading"), F.bool_or(F.expr("no = of and runs_on")).alias("runs_on"))
    page = page.withColumn("block", F.floor(F.col("page_no") / block))
    in_block = Window.partitionBy("output_file", "block").orderBy("page_no", "page_id")
    by_block = Window.partitionBy("output_file").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    leaves = page.groupBy("output_file", "block").agg(F.max_by("runs_on", F.struct("page_no", "page_id")).alias("leaves"))
    leaves = leaves.select("output_file", "block", F.coalesce(F.lag("leaves").over(by_block), F.lit(False)).alias("enters"))
    page = page.join(leaves, ["output_file", "block"])
    page = page.withColumn("continues", F.coalesce(F.lag("runs_on").over(in_block), F.col("enters")) & ~F.col("heading"))
    # where the last paragraph of a page began, if it began on that page
    own = F.when((F.col("of") > 1) | ~F.col("continues"), F.struct("page_no", "page_id", F.col("of").alias("no")))
    page = page.withColumn("own", own).withColumn("carried", F.last("own", ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, -1)))
    last = page.groupBy("output_file", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.struct("page_no", "page_id"))).alias("own"))
    last = last.select("output_file", "block", F.last("own", ignorenulls=True).over(before).alias("earlier"))
    page = page.join(last, ["output_file", "block"]).select("page_id", "continues", F.coalesce("carried", "earlier").alias("from"))
    whole = parts.join(page, "page_id").withColumn("key", F.when(F.expr("no = 1 and continues and from is not null"), F.col("from")).otherwise(key))
    pieces = F.array_sort(F.collect_list(F.struct("page_no", "page_id", "glue", "text")))
    text = F.aggregate("p", F.struct(F.lit("").alias("t"), F.lit(True).alias("g")), lambda a, x: F.struct(F.concat(a["t"], F.when(a["g"], "").otherwise(" "), x["text"]).alias("t"), x["glue"].alias("g")))["t"]
    part = F.floor((F.col("page_no") - F.col("key.page_no")) / part_pages).cast("int")
    done = whole.groupBy("output_file", "key", part.alias("part")).agg(pieces.alias("p"))
    return done.select("output_file", F.col("key.page_no").alias("first_page"), F.col("key.page_id").alias("first_page_id"), F.col("key.no").alias("no"), "part", F.size("p").alias("pages"), text.alias("text"))
