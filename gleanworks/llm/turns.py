"""Speech transcripts into clean speaker turns.

One Aho-Corasick automaton finds names of people, label words, hesitation sounds, filler phrases and words of
sound notes in a text. Context rules decide what a match means: a name is a label only at the opening of a text
and with the marks of a label around it, a bracket is a note if it holds a word of sound notes, a doubtful word is a
filler only if it is set off. What is no speech is subtracted as intervals. Turns are then built by windows
over blocks of an hour, with the state that enters a block carried over from the blocks before it, so that no
task orders a whole recording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.operators.intervals import HOUR_MS, millis
from gleanworks.session import cut_lineage, salted_join

#: Hesitation sounds (letters marked + may be drawn out).
HESITATIONS = "u+h+ u+m+ u+h+m+ e+r+m+ h+m+ m+h+m+ mm-h+m+ u+h+-huh u+h+-uh m+h+ m+m+ e+h+ e+h+m+ e+m+ e+u+h+ h+e+u+ h+u+m+ ä+h+ ä+h+m+ ö+h+m+ a+h+m+ h+ä+".split()
#: Phrases that are fillers wherever they stand.
PHRASES = "you know|i mean|sort of|kind of|tu vois|vous voyez|o sea|sozusagen".split("|")
#: Words that are fillers only if a comma, dots or another filler sets them off.
DOUBTFUL = "like well enfin quoi ben halt also este pues bueno".split()
#: Words of sound notes. A bracket of any kind and length that holds one is a note.
NOTES = (
    "music musique musik música applause applaus applaudissements aplausos laughter laughs laughing rires lachen risas noise bruit geräusch ruido inaudible unintelligible unverständlich "
    "crosstalk sighs sighing coughs coughing tousse hustet tose rings ringing closes slams silence stille static beep beeps barks barking chuckles chuckling cheering cheers gasps groans "
    "sneezes sniffs sobbing footsteps knocking whistles whistling"
).split()
#: Hesitations that are words of a language too, by the beginning of its code.
ALSO_WORDS = {"um": "de", "er": "de", "em": "pt", "hum": "xx"}

TIME = re.compile(
    r"[\[(<]?(?<![\w:.])(?:\d+h\d{1,2}m\d{1,2}s|\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?)(?![\w:])[\])>]?(?:\s*-->)?(?:\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})?"
)
BRACKET = re.compile(r"\(\([^()]*\)\)|\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>|(?<![\w*])\*[^*\s][^*]*\*(?![\w*])|♪+")
#: Runs of one letter beyond the longest spelling in the automaton.
DRAWN = re.compile(r"([^\W\d_])\1{5,}")
OPENING = re.compile(r"(?:\s|>>|[-–—]\s)*")
#: What may follow a name to make it a label, by what stands before it.
CLOSERS = {
    "**": re.compile(r"\s*\*\*\s*:?|\s*:\s*\*\*"),
    "[": re.compile(r"\s*\]\s*:?"),
    "(": re.compile(r"\s*\)\s*:?"),
    "<v": re.compile(r"\s*>\s*:?"),
    "": re.compile(r"\s*:(?!\d)|\s+[-–—](?=\s|$)"),
}
OPENERS = re.compile(r"\*\*\s*|\[\s*|\(\s*|<v\s+|")
NUMBERED = re.compile(r"[ _]{0,3}(\d{1,6})(?!\w)")
WORD = re.compile(r"\w")
BETWEEN = re.compile(r"\s*,?\s+")
INITIAL = re.compile(r"(\w)\.\s*")
SET_OFF = re.compile(r"\s*(\.\.\.|…|,)?")
COUNTED = re.compile(r"\b(a|an|some|this|that|what|any) $")


def drawn_out(pattern: str, most: int = 5) -> set[str]:
    """The spellings of a hesitation in which one marked letter, or none, is repeated, up to ``most`` times (texts are shortened to that)."""
    letters = re.findall(r"(.)(\+?)", pattern)
    plain = [x for x, _ in letters]
    out = {"".join(plain)}
    for n in range(2, most + 1):
        for i, (_, mark) in enumerate(letters):
            if mark:
                out.add("".join([*plain[:i], plain[i] * n, *plain[i + 1 :]]))
        for i in range(len(letters) - 1):
            if letters[i][1] and letters[i + 1][1]:
                out.add("".join([*plain[:i], plain[i] * 2, plain[i + 1] * n, *plain[i + 2 :]]))
    return out


def swapped(word: str) -> set[str]:
    """The word with two neighbouring letters exchanged, the slip that labels show."""
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word}


def level(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Reader:
    """Reads one text: whose it is, and what speech is in it."""

    def __init__(self, roster: list[tuple[int, str, str]], notes: tuple[str, ...] = tuple(NOTES)):
        people: dict[str, set[tuple[str, str]]] = {}
        self.number = {int(no): label for no, label, _ in roster if no is not None}
        for _, label, name in roster:
            parts = level(name or "").split()
            for part, role in [(parts[0], "first"), (parts[-1], "last")] if len(parts) > 1 else [(p, "last") for p in parts]:
                people.setdefault(part, set()).add((label, role))
        slips: dict[str, set[tuple[str, str]]] = {}
        for part, who in people.items():
            for slip in swapped(part) - people.keys() if len(part) > 3 else ():
                slips.setdefault(slip, set()).update(who)
        self.firsts = [(part, label) for part, who in people.items() for label, role in who if role == "first"]
        people |= slips
        kinds: dict[str, tuple[str, object]] = {level(w): ("note", None) for w in notes}
        kinds |= {w: ("doubtful", None) for w in DOUBTFUL} | {w: ("phrase", None) for w in PHRASES}
        kinds |= {w: ("sound", None) for p in HESITATIONS for w in drawn_out(p)}
        kinds |= {w: ("stem", None) for w in ("speaker", "spk", "sprecher", "locuteur", "hablante")}
        kinds |= {w: ("person", frozenset(who)) for w, who in people.items()}
        self.automaton = ahocorasick.Automaton()
        for word, kind in kinds.items():
            self.automaton.add_word(word, (len(word), *kind))
        self.automaton.make_automaton()

    def matches(self, low: str) -> list[tuple[int, int, str, object]]:
        """Whole words and phrases that the automaton finds, from left to right, the longest of those that overlap."""
        if DRAWN.search(low):
            # letters drawn out further than any spelling are shortened, and places mapped back
            places, at = [], 0
            for m in DRAWN.finditer(low):
                places += range(at, m.start() + 5)
                at = m.end()
            places += range(at, len(low) + 1)
            return [(places[a], places[z - 1] + 1 if z < len(places) and places[z] == places[z - 1] + 1 else places[z], *rest) for a, z, *rest in self.matches("".join(low[i] for i in places[:-1]))]
        found = []
        for end, (size, kind, what) in self.automaton.iter(low):
            start, stop = end - size + 1, end + 1
            if (start and (low[start - 1].isalnum() or low[start - 1] == "-" and start > 1 and low[start - 2].isalnum())) or (
                stop < len(low) and (low[stop].isalnum() and kind != "stem" or low[stop] in "-'" and stop + 1 < len(low) and low[stop + 1].isalnum())
            ):
                continue
            while found and found[-1][0] >= start:
                found.pop()
            if not found or found[-1][1] <= start:
                found.append((start, stop, kind, what))
        return found

    def person(self, low: str, at: int, by_start: dict) -> tuple[str, int] | None:
        """The person of the roster named at a place, and where the name ends."""
        hit = by_start.get(at)
        if hit and hit[2] == "stem":
            n = NUMBERED.match(low, hit[1])
            return (self.number[int(n[1])], n.end()) if n and int(n[1]) in self.number else None
        if hit and hit[2] == "person":
            gap = BETWEEN.match(low, hit[1])
            second = by_start.get(gap.end()) if gap else None
            if second and second[2] == "person":
                both = {x for x, _ in hit[3]} & {x for x, _ in second[3]}
                roles = {r for x, r in hit[3] if x in both} | {r for x, r in second[3] if x in both}
                if len(both) == 1 and len(roles) == 2:
                    return both.pop(), second[1]
            alone = {x for x, _ in hit[3]}
            return (alone.pop(), hit[1]) if len(alone) == 1 else None
        initial = INITIAL.match(low, at)
        second = by_start.get(initial.end()) if initial else None
        if second and second[2] == "person":
            who = {x for x, r in second[3] if r == "last" and any(y == x and p.startswith(initial[1]) for p, y in self.firsts)}
            return (who.pop(), second[1]) if len(who) == 1 else None
        return None

    def label(self, low: str, by_start: dict) -> tuple[str | None, int]:
        """The speaker whose label opens the text, and where the speech begins."""
        at = 0
        while True:
            at = OPENING.match(low, at).end()
            time = TIME.match(low, at)
            if not time:
                break
            at = time.end()
        opener = OPENERS.match(low, at)
        who = self.person(low, opener.end(), by_start)
        if who:
            close = CLOSERS[opener[0].strip()].match(low, who[1])
            if close:
                return who[0], close.end()
        return None, at

    def read(self, text: str | None, lang: str | None) -> tuple[str | None, str]:
        """Speaker's label or None, and the clean speech ('' if no word is left)."""
        if not text or not WORD.search(text):
            return None, ""
        low = level(text)
        hits = self.matches(low)
        speaker, begin = self.label(low, {h[0]: h for h in hits})
        out = [(0, begin)] + [m.span() for m in TIME.finditer(low, begin)]
        notes = [h[0] for h in hits if h[2] == "note"]
        for m in BRACKET.finditer(low, begin):
            if m[0][0] == "♪" or any(m.start() < at < m.end() for at in notes):
                out.append(m.span())
        short = (lang or "").lower()[:2]
        gone = None
        for start, stop, kind, _ in hits:
            if start < begin or kind not in ("sound", "phrase", "doubtful"):
                continue
            after = SET_OFF.match(low, stop)
            set_off = bool(after[1]) or gone is not None and not low[gone:start].strip()
            if kind == "doubtful" and not set_off:
                continue
            if kind == "sound" and ALSO_WORDS.get(low[start:stop]) == short and not set_off and WORD.search(low, stop):
                continue
            if kind == "phrase" and COUNTED.search(low[max(0, start - 6) : start]) and low[start:stop].endswith(" of") and not set_off:
                continue
            out.append((start, after.end()))
            gone = after.end()
        return speaker, subtract(text, out)


def subtract(text: str, spans: list[tuple[int, int]]) -> str:
    """What is left of a text without the spans, its spaces and marks put in order; '' if no word is left."""
    parts, at = [], 0
    for start, stop in sorted(spans):
        if start > at:
            parts.append(text[at:start])
        at = max(at, stop)
    parts.append(text[at:])
    left = re.sub(r"\s+", " ", " ".join(parts))
    left = re.sub(r"(?: ?[,.…]+)+ (?=[,.!?])| (?=[,.!?;:](?:\s|$))", "", left)
    left = re.sub(r"^[\s,.;:!?…-]+(?=\w)", "", left).strip()
    return left if WORD.search(left) else ""


_PARSED = "media_id string, seg_id bigint, start_ms bigint, end_ms bigint, label string, speech string"


def _parse(roster: list[tuple], notes: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(roster, notes)
        for b in batches:
            read = [reader.read(t, g) for t, g in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
            cols = [b.column(c) for c in ("media_id", "seg_id", "start_ms", "end_ms")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([x for x, _ in read], pa.string()), pa.array([x for _, x in read], pa.string())],
                names=["media_id", "seg_id", "start_ms", "end_ms", "label", "speech"],
            )

    return run


def speaker_turns(segments: DataFrame, roster: DataFrame, pause_ms: int = HOUR_MS, block_ms: int = HOUR_MS, max_roster: int = 20_000, notes: tuple[str, ...] = tuple(NOTES)) -> DataFrame:
    """Segments that hold speech, each with its speaker and the number of its turn.

    Input: ``media_id, seg_id, start_s, end_s, text, lang`` and a roster ``speaker_no, diar_label, full_name`` of at
    most ``max_roster`` people (a longer one raises ValueError: the automaton is held by every task). Output:
    ``media_id, seg_id, start_ms, end_ms, speaker, speech, turn`` with turn rising in the order of a recording.

    A row counts if media_id, seg_id and both bounds are present and the end is after the start; of rows with one
    media_id and seg_id and equal bounds that with the greatest speech counts. ``notes`` are the words of sound notes. A segment without a word (null, blank, only label, times, sounds
    and notes) carries neither label nor turn, but its end counts for pauses. After a pause of ``pause_ms`` the
    speaker is unknown until the next label. Ties in time go by seg_id. Further columns are ignored, an empty table
    gives no row, and a text of any length is read whole.
    """
    people = roster.select("speaker_no", "diar_label", "full_name").filter("diar_label is not null").limit(max_roster + 1).collect()
    if len(people) > max_roster:
        raise ValueError(f"the roster has more than {max_roster} people")
    valid = segments.filter(
        "media_id is not null and seg_id is not null and start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s) and abs(start_s) < 9e15 and abs(end_s) < 9e15 and end_s > start_s"
    ).select("media_id", F.col("seg_id").cast("bigint").alias("seg_id"), millis("start_s").alias("start_ms"), millis("end_s").alias("end_ms"), "text", "lang")
    block = F.floor(F.col("start_ms") / block_ms).alias("block")
    over_blocks = Window.partitionBy("media_id").orderBy("block")
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    reach = valid.groupBy("media_id", block).agg(F.max("end_ms").alias("reach"))
    reach = reach.select("media_id", "block", F.max("reach").over(earlier).alias("reach_before"))

    in_block = Window.partitionBy("media_id", "block").orderBy("start_ms", "end_ms", "seg_id")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = valid.mapInArrow(_parse([tuple(p) for p in people], notes), _PARSED).withColumn("block", block).repartition("media_id", "block")
    # in the order of the windows below, so that it is sorted once
    rows = rows.groupBy("media_id", "block", "start_ms", "end_ms", "seg_id").agg(F.max(F.struct("speech", "label")).alias("x"))
    rows = rows.select("media_id", "block", "start_ms", "end_ms", "seg_id", "x.*").join(reach, ["media_id", "block"])
    latest = F.greatest("reach_before", F.max("end_ms").over(in_block.rowsBetween(Window.unboundedPreceding, -1)))
    spoken = F.col("speech") != ""
    rows = rows.withColumn("pause", F.coalesce(F.col("start_ms") - latest >= pause_ms, F.lit(False)).cast("int"))
    rows = rows.withColumn("event", F.when(spoken & F.col("label").isNotNull(), F.col("label")).when(F.col("pause") == 1, F.lit("unknown")))
    rows = rows.select(
        "media_id", "block", "seg_id", "start_ms", "end_ms", "speech",
        F.last("event", ignorenulls=True).over(so_far).alias("own"),
        F.sum("pause").over(so_far).alias("pauses"),
    )
    rows = cut_lineage(rows)

    order = F.struct("start_ms", "end_ms", "seg_id")
    state = rows.groupBy("media_id", "block").agg(F.max_by("own", order).alias("leaves"), F.max("pauses").alias("pauses_here"))
    state = state.select(
        "media_id", "block",
        F.coalesce(F.last("leaves", ignorenulls=True).over(earlier), F.lit("unknown")).alias("enters"),
        F.coalesce(F.sum("pauses_here").over(earlier), F.lit(0)).alias("pauses_before"),
    )
    said = rows.filter(spoken).join(state, ["media_id", "block"]).select(
        "media_id", "block", "seg_id", "start_ms", "end_ms", "speech",
        F.coalesce("own", "enters").alias("speaker"),
        (F.col("pauses") + F.col("pauses_before")).alias("sitting"),
    )
    mark = F.struct("sitting", "speaker")
    said = said.withColumn("mark", mark).withColumn("fresh", (~F.lag("mark").over(in_block).eqNullSafe(F.col("mark"))).cast("int"))
    said = said.withColumn("n", F.sum("fresh").over(so_far))
    ends = said.groupBy("media_id", "block").agg(F.min_by("mark", order).alias("head"), F.max_by("mark", order).alias("tail"), F.max("n").alias("marks"))
    # the first run of a block goes on with the last one of the block before it if the marks are equal
    joined = F.lag("tail").over(over_blocks).eqNullSafe(F.col("head")).cast("int")
    ends = ends.withColumn("joined", joined)
    offset = F.coalesce(F.sum(F.col("marks") - F.col("joined")).over(earlier), F.lit(0)) - F.col("joined")
    ends = ends.select("media_id", "block", offset.alias("turns_before"))
    return said.join(ends, ["media_id", "block"]).select(
        "media_id", "seg_id", "start_ms", "end_ms", "speaker", "speech", (F.col("n") + F.col("turns_before")).alias("turn")
    )


def turn_bounds(turns: DataFrame) -> DataFrame:
    """One row per turn: its speaker, and its first and last segment."""
    order = F.struct("start_ms", "end_ms", "seg_id")
    return turns.groupBy("media_id", "turn").agg(
        F.first("speaker").alias("speaker"),
        F.min_by("seg_id", order).alias("first_seg_id"),
        F.max_by("seg_id", order).alias("last_seg_id"),
    )


def turn_texts(turns: DataFrame, part_ms: int = HOUR_MS) -> DataFrame:
    """One row per turn with its clean text; of a turn that goes on for more than ``part_ms`` one row per ``part`` of that length.

    So no row and no task holds more speech than is begun in that time.
    """
    begins = turns.groupBy("media_id", "turn").agg(F.min("start_ms").alias("begin"))
    rows = salted_join(turns, begins, ["media_id", "turn"], "seg_id").withColumn("part", F.floor((F.col("start_ms") - F.col("begin")) / part_ms).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "seg_id", "speech")))
    return rows.groupBy("media_id", "turn", "part").agg(
        F.first("speaker").alias("speaker"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.count("*").alias("segments"),
        F.array_join(F.transform(parts, lambda x: x["speech"]), " ").alias("text"),
    )
