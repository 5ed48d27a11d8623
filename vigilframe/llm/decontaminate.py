"""Benchmark decontamination by templates: texts are compared with numbers, names and units replaced by what they are.

A text becomes a sequence of canonical tokens. A number is <num>, a number with a unit <qty>, a run of capitalised words
that does not begin a sentence or line <name>; other words are lower-cased and lose the signs around them. Windows of WINDOW
tokens of all documents meet the benchmark's windows in a hash join on the window's text. Windows of a document that
stand as far from an item's windows as each other form an alignment; an alignment is a match if it covers enough of the
item's windows and if its slots agree: slot values of the item have one value in the document nearly throughout (two
numbers may become equal, or equal ones differ, now and then), or most windows are the item's with their slot values. So
a copy matches, and a question asked again with other numbers or names too, but not tokens that happen to stand alike.
Inserted and deleted tokens split a passage: alignments whose distances lie near each other are put together in the item's
order, and together have to cover most of the item's tokens or windows.
Windows with few words, and items with few tokens, are compared with the values of their slots, so their copies match; where
an item has windows with words enough, covering enough of those will do.
Where capitals were changed names can't be told, so a second form of every text, with names as plain words, is
compared in the same way, and the better of the two counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.llm.common import arrow_rows
from vigilframe.llm.encoding import row_slices
from vigilframe.session import stage

#: Tokens of a window; an item with fewer is a window of its own length, one with fewer than LEAST is compared with the
#: values of its slots. A changed word spoils as
#: many windows as a window has tokens, so short windows let short items be found with a word changed; that windows
#: must stand in one alignment keeps them from matching by chance.
WINDOW, LEAST = 5, 4
#: Of a window's tokens, this share at least must be words and not placeholders; else slots count with their values.
LITERAL = 0.5
#: Share of an item's windows that one alignment must cover.
COVERAGE = 0.5
#: Of an alignment's slots, this share at least must have the value that their item value has most often in the document;
#: or more than SAME of its windows must have equal slot values.
AGREEING, SAME = 3 / 4, 2 / 3
#: Alignments are put together that lie at most this many tokens, or this part of a long item's tokens, from each other.
BAND, BAND_SHARE = 16, 4
#: Put together they cover at least this share of the item's tokens, or of its windows: more than one alignment
#: needs, since a text with the frame of an item around another middle is not the item.
PARTS_TOKENS, PARTS_WINDOWS = 0.8, 0.65
#: What going on with another distance costs, and what a window with equal slot values is worth more than others.
CHANGE, EQUAL = 0.5, 0.1
#: A window that several items hold weighs the less the more they are. A match holds at least WEIGHED of the weight of an
#: item's windows, put together from parts at least WEIGHED_PARTS: a frame that many items share is no item.
WEIGHED, WEIGHED_PARTS = 0.25, 0.15
#: Sums of weights in different order differ by less.
ROUNDED = 1e-9
#: Bits of the filter of benchmark windows, least and most (32 MB), and bits to a window; a false hit only costs a join row.
FILTER_BITS, MOST_FILTER_BITS, FILTER_SHARE = 1 << 23, 1 << 28, 16
#: Texts of a batch that are canonicalised together.
TEXTS_AT_ONCE = 512
#: Stands for a line's end among the words of a text; no character of Unicode.
LINE_END = "\ufdd0"
#: Groups of windows that a task gets from Arrow at once.
GROUP_ROWS = 512
#: Words kept with their canonical form in a worker.
KEPT_WORDS = 200_000

UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds ton tons ml cl dl l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa kpa bar c f k percent % $ usd eur gbp dollar dollars cent cents euro euros € £ "
    "kb mb gb tb byte bytes bit bits mph kmh rpm degree degrees °"
)
_UNITS = frozenset(UNITS.split())
_QUANTITY = re.compile(r"^([$€£]?)[+-]?\d[\d.,:/]*([^\W\d_]+|[%°$€£])?$")
WORD, NUMBER, QUANTITY, UNIT, NAME, NOTHING = range(6)
NAMES_TYPED, NAMES_AS_WORDS = 0, 1
PLACEHOLDER = {NUMBER: "<num>", QUANTITY: "<qty>", NAME: "<name>"}
#: Stands before each token of a window that is compared with the values of its slots; no token holds it.
VALUED = "\x1f"


def canonical_word(word: str) -> tuple[str, int, bool, bool]:
    """(literal, kind, may be a name, ends a sentence) of what stands between white space."""
    core, ends = word, False
    if not core.isalpha():
        core, ends = word[:-1], word[-1] == "."
        if word[-1] not in ".," or not core.isalpha():
            return _marked_word(word)
    # words in capitals throughout are shouted or short forms, and stay words
    return core.lower(), WORD, core[0].isupper() and not core.isupper(), ends


def _marked_word(word: str) -> tuple[str, int, bool, bool]:
    """The same for a word with other signs than letters and a stop."""
    core = word.strip("\"'`´‘’“”«»()[]{}<>*#_~|.,;:!?&-–—…=+^\\")
    ends = word.rstrip("\"'’”»)]}*#_~&%$")[-1:] in {".", "!", "?", ":"}
    lower = core.lower()
    if not core:
        return ("", UNIT, False, ends) if word in _UNITS else ("", NOTHING, False, ends)
    found = _QUANTITY.match(lower)
    if found:
        unit = found.group(1) or found.group(2)
        if not unit:
            return lower, NUMBER, False, ends
        if unit in _UNITS:
            return lower, QUANTITY, False, ends
    if not any(sign.isalnum() for sign in core):
        return ("", UNIT, False, ends) if core in _UNITS else ("", NOTHING, False, ends)
    return lower, WORD, core[0].isupper() and any(sign.islower() for sign in core), ends


class Tokens:
    """Canonical tokens of the texts of a batch in one form: kinds, hashes, and the literal of each, put together when asked for.

    ``text`` says which text a token is of. ``plain`` has the hashes of the tokens' first words, also where ``hashes``
    has a placeholder's. ``first`` is each token's first word, ``joined`` tells words that belong to the token before.
    """

    def __init__(
        self, kinds: np.ndarray, hashes: np.ndarray, plain: np.ndarray, text: np.ndarray, first: np.ndarray, joined: np.ndarray, places: np.ndarray,
        literals: list[str],
    ):
        self.kinds, self.hashes, self.plain, self.text, self._first, self._joined, self._places, self._literals = kinds, hashes, plain, text, first, joined, places, literals

    def literal(self, token: int) -> str:
        """What the token stands for; a quantity's unit and the other words of a name belong to it."""
        word = int(self._first[token])
        found = self._literals[self._places[word]]
        while (word := word + 1) < len(self._joined) and self._joined[word]:
            found = f"{found} {self._literals[self._places[word]]}"
        return found

    def template(self, start: int, size: int, valued: bool = False) -> tuple[str, list[str]]:
        """The window's tokens as one text, with the values of its slots if asked for, and its slots with their values."""
        kinds, values = self.kinds[start : start + size].tolist(), [self.literal(token) for token in range(start, start + size)]
        text = " ".join(PLACEHOLDER.get(kind, value) for kind, value in zip(kinds, values, strict=True))
        if valued:
            text = "".join(f"{VALUED}{PLACEHOLDER.get(kind, '')}{value}" for kind, value in zip(kinds, values, strict=True))
        return text, [f"{PLACEHOLDER[kind]}{value}" for kind, value in zip(kinds, values, strict=True) if kind in PLACEHOLDER]


class Canonicaliser:
    """Turns texts into canonical tokens; forms of words met before are kept, up to a bound."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.literals: list[str] = []
        self.hashes = np.zeros(1024, dtype=np.uint64)
        #: kind, may be a name, ends a sentence, is a unit
        self.flags = np.zeros((1024, 4), dtype=np.uint8)

    def learn(self, words: list[str]) -> None:
        from xxhash import xxh64_intdigest

        known, total = len(self.literals), len(self.literals) + len(words)
        if total > len(self.hashes):
            more = max(total, 2 * len(self.hashes)) - len(self.hashes)
            self.hashes = np.concatenate((self.hashes, np.zeros(more, dtype=np.uint64)))
            self.flags = np.concatenate((self.flags, np.zeros((more, 4), dtype=np.uint8)))
        rows = [canonical_word(word) for word in words]
        self.number.update(zip(words, range(known, total), strict=True))
        self.literals.extend(row[0] for row in rows)
        self.hashes[known:total] = [xxh64_intdigest(row[0]) for row in rows]
        self.flags[known:total] = [(kind, proper, ends, literal in _UNITS) for literal, kind, proper, ends in rows]

    def forms(self, text: str) -> Iterator[tuple[list[int], Tokens]]:
        """(forms, tokens) of one text: names typed, and names as words like others; one item for both where there are no names."""
        for tokens, form, named in self.batch_forms([text]):
            yield [form] if named.any() else [NAMES_TYPED, NAMES_AS_WORDS], tokens

    def batch_forms(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[Tokens, int, np.ndarray]]:
        """(tokens, form, texts with names): names typed in all texts, then, as words, in those that have some.

        The typed form of a text without names is both of its forms.
        """
        places, names, text, number = self.read(texts)
        named = np.zeros(number, dtype=bool)
        named[text[names]] = True
        yield self.tokens(places, names, text), NAMES_TYPED, named
        if named.any():
            some = named[text]
            yield self.tokens(places[some], np.zeros(int(some.sum()), dtype=bool), text[some]), NAMES_AS_WORDS, named

    def read(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(numbers of all words, which of them may be names, the text each is of, number of texts)."""
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.utf8_split_whitespace(pc.replace_substring(pc.fill_null(given, ""), "\n", f" {LINE_END} "))
        words, counts = split.flatten(), split.value_lengths().to_numpy()
        text = np.repeat(np.arange(len(given)), counts)
        filled = pc.greater(pc.binary_length(words), 0)
        words, text = words.filter(filled), text[filled.to_numpy(zero_copy_only=False)]
        numbered = words.dictionary_encode()
        different = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(numbered.dictionary)], pa.int32()), numbered.dictionary), " ")[0].as_py().split(" ")
        if not len(numbered.dictionary):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), text, len(given)
        if len(self.number) > KEPT_WORDS:
            self.__init__()
        if fresh := [word for word in different if word not in self.number]:
            self.learn(fresh)
        places = np.fromiter(map(self.number.__getitem__, different), dtype=np.int64, count=len(different))[numbered.indices.to_numpy()]
        ends = places == self.number[LINE_END] if LINE_END in self.number else np.zeros(len(places), dtype=bool)
        begins = np.ones(len(places), dtype=bool)
        begins[1:] = ends[:-1] | (text[1:] != text[:-1])
        if ends.any():
            places, text, begins = places[~ends], text[~ends], begins[~ends]
        flags = self.flags[places]
        begins[1:] |= flags[:-1, 2].astype(bool)
        return places, flags[:, 1].astype(bool) & ~begins, text, len(given)

    def tokens(self, places: np.ndarray, names: np.ndarray, text: np.ndarray) -> Tokens:
        flags, hashes = self.flags[places], self.hashes[places]
        kinds, ends, unit = flags[:, 0].copy(), flags[:, 2].astype(bool), flags[:, 3].astype(bool)
        kinds[names] = NAME
        there = kinds != NOTHING  # signs alone are no tokens
        if not there.all():
            kinds, hashes, places, unit, ends, text = kinds[there], hashes[there], places[there], unit[there], ends[there], text[there]
        before = np.full(len(kinds), NOTHING, dtype=np.uint8)
        before[1:] = kinds[:-1]
        broken = np.zeros(len(kinds), dtype=bool)
        broken[1:] = ends[:-1] | (text[1:] != text[:-1])
        measured = unit & (before == NUMBER) & ~broken  # a number and its unit are one quantity
        kinds[np.flatnonzero(measured) - 1] = QUANTITY
        kinds[(kinds == UNIT) & ~measured] = NOTHING
        joined = measured | ((kinds == NAME) & (before == NAME) & ~broken)
        first = np.flatnonzero(~joined & (kinds != NOTHING))
        kinds, plain = kinds[first], hashes[first]
        hashes = plain.copy()
        for kind in PLACEHOLDER:
            hashes[kinds == kind] = np.uint64(kind)
        return Tokens(kinds, hashes, plain, text[first], first, joined, places, self.literals)


def window_hashes(hashes: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all windows of ``size`` tokens, or of those at ``starts``."""
    number = len(hashes) - size + 1
    found = np.zeros(number if starts is None else len(starts), dtype=np.uint64)
    for place in range(size):
        found = (found + (hashes[place : number + place] if starts is None else hashes[starts + place])) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def template_tokens(template: str) -> list[str]:
    return template.split(VALUED)[1:] if template.startswith(VALUED) else template.split(" ")


def first_word(token: str) -> str:
    """What Tokens.plain hashes of a token of a template with values."""
    for sign in PLACEHOLDER.values():
        token = token.removeprefix(sign)
    return token.split(" ", 1)[0]


def windows_of(tokens: Tokens, size: int, keep: np.ndarray | None, texts: np.ndarray | None = None) -> Iterator[tuple[int, int, str, list[str]]]:
    """(text, place in it, template, slots) of the windows of ``size`` tokens that ``keep`` lets pass, of all or of some texts.

    A window with too few words, or of fewer than LEAST tokens, has its slots' values in the template; one of fewer
    than LEAST tokens comes once a text.
    """
    number = len(tokens.kinds) - size + 1
    if number <= 0:
        return
    words = np.concatenate(([0], np.cumsum(tokens.kinds == WORD)))
    valued = np.full(number, size < LEAST) | (words[size:] - words[:-size] < LITERAL * size)
    wanted = tokens.text[:number] == tokens.text[size - 1 :]
    if texts is not None:
        wanted &= texts[tokens.text[:number]]
    if keep is not None:
        if not valued.all():
            wanted &= valued | in_filter(keep, window_hashes(tokens.hashes, size))
        places = np.flatnonzero(wanted & valued)
        wanted[places] = in_filter(keep, window_hashes(tokens.plain, size, places))
    seen: set[tuple[int, str]] = set()
    found = np.flatnonzero(wanted)
    starts = np.searchsorted(tokens.text, tokens.text[found])
    for place, start in zip(found.tolist(), starts.tolist(), strict=True):
        template, slots = tokens.template(place, size, bool(valued[place]))
        text = int(tokens.text[place])
        if size < LEAST:
            if (text, template) in seen:
                continue
            seen.add((text, template))
        yield text, place - start, template, slots


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where both of a hash's bits are set."""
    mask = np.uint64(8 * len(bits) - 1)
    first = hashes & mask
    found = (bits[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    some = np.flatnonzero(found)
    second = hashes[some] >> np.uint64(32) & mask
    found[some] = bits[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8) & 1
    return found


_WINDOWS = pa.schema([("id", pa.int64()), ("form", pa.int32()), ("size", pa.int32()), ("place", pa.int32()), ("template", pa.string()), ("slots", pa.list_(pa.string()))])
WINDOW_SCHEMA = "id long, form int, size int, place int, template string, slots array<string>"


def _rows(rows: list[tuple], schema: pa.Schema = _WINDOWS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def text_forms(form: int, is_named: bool) -> tuple[int, ...]:
    return (form,) if is_named else (NAMES_TYPED, NAMES_AS_WORDS)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Windows of every item; an item of fewer tokens than a window is one window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonicaliser()
        for batch in row_slices(batches):
            ids, rows = batch.column(0).to_pylist(), []
            for tokens, form, named in canonical.batch_forms(batch.column(1)):
                lengths = np.bincount(tokens.text, minlength=len(ids))
                for size in range(1, window + 1):
                    some = lengths == size if size < window else lengths >= size
                    for text, *one in windows_of(tokens, size, None, some):
                        rows.extend((ids[text], each, size, *one) for each in text_forms(form, named[text]))
            if rows:
                yield _rows(rows)

    read = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return read.mapInArrow(cut, WINDOW_SCHEMA)


def window_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit filter of all windows in ``items``, and the sizes that occur.

    Its bits are FILTER_SHARE to a window within fixed bounds; with more windows than fit it lets more pass, which
    costs join rows and no match.
    """
    number = items.count()
    size = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << max(0, (FILTER_SHARE * number - 1).bit_length())))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        bits, sizes = np.zeros(size // 8, dtype=np.uint8), set()
        signs = {sign: kind for kind, sign in PLACEHOLDER.items()}
        for batch in batches:
            for length, template in zip(*batch.columns, strict=True):
                tokens, valued = template_tokens(template.as_py()), template.as_py().startswith(VALUED)
                hashed = np.array([xxh64_intdigest(first_word(token)) if valued else signs[token] if token in signs else xxh64_intdigest(token) for token in tokens], dtype=np.uint64)
                value = window_hashes(hashed, len(tokens))
                for place in (value & np.uint64(size - 1), value >> np.uint64(32) & np.uint64(size - 1)):
                    np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
                sizes.add(length.as_py())
        if sizes:
            yield pa.record_batch([pa.array([bits.tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["bits", "sizes"])

    bits, sizes = np.zeros(size // 8, dtype=np.uint8), set()
    for row in items.select("size", "template").distinct().coalesce(4).mapInArrow(mark, "bits binary, sizes array<int>").toLocalIterator():
        bits |= np.frombuffer(bytes(row.bits), dtype=np.uint8)
        sizes.update(row.sizes)
    return bits, sorted(sizes)


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Windows of every whole text that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    canonical: list[Canonicaliser] = []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not canonical:
            canonical.append(Canonicaliser())
        for batch in row_slices(batches, TEXTS_AT_ONCE):
            ids, rows = batch.column(0).to_pylist(), []
            for tokens, form, named in canonical[0].batch_forms(batch.column(1)):
                for size in sizes:
                    for text, *one in windows_of(tokens, size, shared.value):
                        rows.extend((ids[text], each, size, *one) for each in text_forms(form, named[text]))
                        if len(rows) > 10_000:
                            yield _rows(rows)
                            rows = []
            if rows:
                yield _rows(rows)

    read = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return read.mapInArrow(cut, WINDOW_SCHEMA)


def slots_agree(alignment: dict[int, dict]) -> bool:
    """Whether an alignment's windows, by place in the item, are one text's."""
    pairs: dict[int, tuple[str, str]] = {}
    for place, one in alignment.items():
        slots = [number for number, token in enumerate(template_tokens(one["template"])) if token.startswith(tuple(PLACEHOLDER.values()))]
        pairs.update((place + number, pair) for number, pair in zip(slots, zip(one["item_slots"], one["slots"], strict=True), strict=True))
    usual: dict[str, int] = {}
    for (theirs, _), number in Counter(pairs.values()).items():
        usual[theirs] = max(usual.get(theirs, 0), number)
    if sum(usual.values()) >= AGREEING * len(pairs):
        return True
    return sum(one["item_slots"] == one["slots"] for one in alignment.values()) > SAME * len(alignment)


def weighs_enough(alignment: dict[int, dict], group: dict, share: float) -> bool:
    """Whether the windows hold this share of the weight of all the item's windows, or of those that have words enough."""
    weight = sum(one["weight"] for one in alignment.values())
    worded = sum(one["weight"] for one in alignment.values() if not one["template"].startswith(VALUED))
    return weight >= share * group["item_weight"] - ROUNDED or worded >= share * group["worded_weight"] - ROUNDED > -ROUNDED


def best_covered(alignment: dict[int, dict], item_windows: int, worded_windows: int) -> tuple[int, int]:
    """(matched, item's) windows, of all or of those that have words enough, whichever is the larger share."""
    worded = sum(not one["template"].startswith(VALUED) for one in alignment.values())
    if worded * item_windows > len(alignment) * worded_windows:
        return worded, worded_windows
    return len(alignment), item_windows


JUDGED_SCHEMA = "doc_id long, item_id long, matched_windows long, item_windows long, coverage double, changed_slots long"
_JUDGED = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_windows", pa.int64()), ("item_windows", pa.int64()), ("coverage", pa.float64()), ("changed_slots", pa.int64())])


def _judged(batches: Iterator[pa.RecordBatch], coverage: float) -> Iterator[pa.RecordBatch]:
    """The best match, if any, of each group: an item's windows in a document within a band of shifts."""
    for batch in batches:
        rows = []
        for group in (row.as_py() for row in batch.to_struct_array()):
            by_shift: dict[int, dict[int, dict]] = {}
            for one in group["windows"]:  # of rows that repeat an id, the one that is more alike
                alignment = by_shift.setdefault(one["shift"], {})
                if one["item_place"] not in alignment or one["item_slots"] == one["slots"]:
                    alignment[one["item_place"]] = one
            found = []
            for alignment in by_shift.values():
                matched, total = best_covered(alignment, group["item_windows"], group["worded_windows"])
                if matched >= coverage * total and weighs_enough(alignment, group, WEIGHED):
                    found.append((matched, total, alignment))
            if len(by_shift) > 1:
                alignment = put_together(by_shift)
                tokens = {place + number for place, one in alignment.items() for number in range(one["size"])}
                matched, total = best_covered(alignment, group["item_windows"], group["worded_windows"])
                enough = len(tokens) >= PARTS_TOKENS * group["item_tokens"] or matched >= max(coverage, PARTS_WINDOWS) * total
                if enough and weighs_enough(alignment, group, WEIGHED_PARTS):
                    found.append((matched, total, alignment))
            judged = []
            for matched, total, alignment in found:
                if slots_agree(alignment):
                    changed = {theirs for one in alignment.values() for theirs, ours in zip(one["item_slots"], one["slots"], strict=True) if theirs != ours}
                    judged.append((matched / total, matched, -len(changed), total))
            if judged:
                share, matched, unchanged, total = max(judged)
                rows.append((group["doc_id"], group["item_id"], matched, total, share, -unchanged))
        if rows:
            yield _rows(rows, _JUDGED)


def put_together(by_shift: dict[int, dict[int, dict]]) -> dict[int, dict]:
    """Windows by place in the item, in the order of item and document, from alignments at several shifts.

    The most windows, less a cost for each change of the shift; windows with equal slot values are worth a little more.
    """
    shifts = np.array(sorted(by_shift))
    places = np.array(sorted({place for alignment in by_shift.values() for place in alignment}))
    # score[s, k]: of the best row of windows that ends at shift s among the first k places; ends[s, k]: the last one's place
    score, ends = np.zeros((len(shifts), len(places) + 1)), np.full((len(shifts), len(places) + 1), -1)
    before: dict[tuple[int, int], tuple[int, int]] = {}
    lines, apart = np.arange(len(shifts)), np.maximum(0, shifts[:, None] - shifts[None, :])
    for k, place in enumerate(places.tolist()):
        score[:, k + 1], ends[:, k + 1] = score[:, k], ends[:, k]
        for s, shift in enumerate(shifts.tolist()):
            one = by_shift[shift].get(place)
            if one is None:
                continue
            # at a larger shift the windows before must end so much earlier in the item
            reach = np.searchsorted(places, place - 1 - apart[:, s], side="right")
            gained = score[lines, reach] - CHANGE * (lines != s)
            prior = int(np.argmax(gained))
            value = 1 + EQUAL * (one["item_slots"] == one["slots"]) + max(0.0, float(gained[prior]))
            if value > score[s, k + 1]:
                score[s, k + 1], ends[s, k + 1] = value, k
                before[s, k] = (prior, int(ends[prior, reach[prior]])) if gained[prior] > 0 else (-1, -1)
    s = int(np.argmax(score[:, -1]))
    k, chosen = int(ends[s, -1]), {}
    while k >= 0:
        place = int(places[k])
        chosen[place] = by_shift[int(shifts[s])][place]
        s, k = before[s, k]
    return chosen


def telling_windows() -> Column:
    """True for windows one of which every match of an item holds.

    The windows that most items share are left out as long as all left out weigh less than WEIGHED_PARTS of the item,
    and those of them with words enough less than that share of all such: then the others have to be met.
    """
    worded = (~F.col("template").startswith(VALUED)).cast("int")
    common_first = Window.partitionBy("item_id", "form").orderBy("weight", "template", "place").rowsBetween(Window.unboundedPreceding, 0)
    left_out = F.sum("weight").over(common_first) < WEIGHED_PARTS * F.col("item_weight") - ROUNDED
    worded_left_out = F.sum(F.col("weight") * worded).over(common_first) < WEIGHED_PARTS * F.col("worded_weight") - ROUNDED
    return ~(left_out & ((worded == 0) | worded_left_out))


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, coverage, changed_slots) of each document and item that match.

    Windows that several items hold weigh less, so what items have in common is no match of them all. The best alignment of a pair, or alignments near each other put together, in either form, is returned;
    changed_slots counts the slot values that differ, 0 for a copy. Windows are all of the item's, or those with words
    enough where these are covered better; parts put together may cover the tokens of an item and few of its windows.
    Null and empty texts and items without words and numbers match nothing; an item of fewer than LEAST tokens matches
    wherever these stand with their values; rows that repeat an id are taken as one document; a null id is an id; an
    empty table on either side gives an empty result; other columns are not read.
    """
    items = stage(benchmark_windows(benchmark, window, item_column, item_text).withColumnRenamed("id", "item_id"))
    bits, sizes = window_filter(items)
    found = stage(document_windows(docs, bits, sizes, id_column, text_column))
    worded = (~F.col("template").startswith(VALUED)).cast("int")
    shared = items.groupBy("form", "size", "template").agg((1 / F.count_distinct(F.struct("item_id"))).alias("weight"))
    weighed = stage(items.join(shared, ["form", "size", "template"]))
    of_item = stage(weighed.groupBy(F.col("item_id").alias("of"), F.col("form").alias("of_form")).agg(
        F.count(F.lit(1)).alias("item_windows"), F.sum(worded).alias("worded_windows"), (F.max("place") + F.max("size")).alias("item_tokens"),
        F.sum("weight").alias("item_weight"), F.sum(F.col("weight") * worded).alias("worded_weight"),
    ))
    same_item = F.col("item_id").eqNullSafe(F.col("of")) & (F.col("form") == F.col("of_form"))
    named = stage(weighed.join(of_item, same_item).select(
        "item_id", "form", "size", F.col("place").alias("item_place"), "template", F.col("slots").alias("item_slots"), "weight",
        F.greatest(F.lit(BAND), F.floor(F.col("item_tokens") / BAND_SHARE)).cast("int").alias("width"), telling_windows().alias("is_telling"),
    ))
    # a match holds a telling window, so only those meet the corpus; the others are looked up for the pairs that have one
    telling = named.where("is_telling").select("form", "size", "template", "item_id").distinct()
    pairs = stage(found.join(telling, ["form", "size", "template"]).select("id", "item_id", "form").distinct())
    in_pair = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("form") == F.col("pair_form"))
    of_pair = F.col("item_id").eqNullSafe(F.col("pair_item")) & (F.col("named.form") == F.col("found.form")) & (F.col("named.size") == F.col("found.size")) & (F.col("named.template") == F.col("found.template"))
    held = found.join(pairs.select(F.col("id").alias("doc_id"), F.col("item_id").alias("pair_item"), F.col("form").alias("pair_form")), in_pair)
    met = stage(held.alias("found").join(named.alias("named"), of_pair).select(
        "doc_id", "item_id", F.col("found.form"), F.col("found.size"), (F.col("found.place") - F.col("item_place")).alias("shift"), "width", "item_place",
        F.col("found.template"), "item_slots", F.col("found.slots"), "weight"))
    # bands of two widths, each a width further than the one before, so that any two shifts within a width share one
    at = ["doc_id", "item_id", "form", "band"]
    number = F.floor(F.col("shift") / F.col("width")).cast("int")
    bands = F.explode(F.array(number - 1, number)).alias("band")
    placed = met.groupBy("doc_id", "item_id", "form", "shift", "width", "item_place").agg(
        F.max("size").alias("size"), F.max(worded).alias("is_worded"), F.max("weight").alias("weight"))
    counted = placed.groupBy("doc_id", "item_id", "form", "shift", "width").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_worded").alias("n_worded"), F.max("size").alias("size"), F.sum("weight").alias("weight"),
        F.sum(F.col("weight") * F.col("is_worded")).alias("w_worded"))
    # at most what a band's alignments can cover together; what they do cover is judged from their windows
    most = counted.select("*", bands).groupBy(*at).agg(
        F.sum("n").alias("n"), F.sum("n_worded").alias("n_worded"), F.sum(F.col("n") + F.col("size") - 1).alias("tokens"),
        F.sum("weight").alias("weight"), F.sum("w_worded").alias("w_worded"))
    covered = (F.col("n") >= min(coverage, PARTS_WINDOWS) * F.col("item_windows")) | ((F.col("n_worded") > 0) & (F.col("n_worded") >= coverage * F.col("worded_windows")))
    covered = covered | (F.col("tokens") >= PARTS_TOKENS * F.col("item_tokens"))
    covered = covered & ((F.col("weight") >= WEIGHED_PARTS * F.col("item_weight") - ROUNDED) | (F.col("w_worded") >= WEIGHED_PARTS * F.col("worded_weight") - ROUNDED))
    facts = ["item_windows", "worded_windows", "item_tokens", "item_weight", "worded_weight"]
    enough = most.join(of_item, same_item).where(covered).select(*[F.col(name).alias(f"at_{name}") for name in at], *facts)
    here = F.lit(True)
    for name in at:
        here = here & F.col(name).eqNullSafe(F.col(f"at_{name}"))
    groups = met.select("*", bands).join(enough, here).groupBy(*at, *facts).agg(F.collect_set(F.struct("item_place", "shift", "size", "template", "item_slots", "slots", "weight")).alias("windows"))
    with arrow_rows(docs.sparkSession, GROUP_ROWS):
        kept = stage(groups.mapInArrow(lambda batches: _judged(batches, coverage), JUDGED_SCHEMA))
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched_windows", (-F.col("changed_slots")).alias("unchanged"), "item_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched_windows", "best.item_windows", "best.coverage", (-F.col("best.unchanged")).alias("changed_slots"))
