"""Benchmark decontamination by template windows.

Texts are turned into templates: numbers, names and units of measure become typed
placeholders, all else is lower-cased words. Numbers may be written out: numerals in a row, or behind digits, are one number. Capitals in a row, at most LONGEST_NAME of them,
are one name; longer runs are headings and stay words. A capital that opens a sentence may be
a name or not: texts have two readings, one with these capitals as words and one with all
capitals as names, and windows of one reading meet windows of the same.

Windows of WINDOW template tokens are hashed and joined with the windows of the benchmark items.
Windows that lie on one diagonal (same distance between place in the document and in the
item) are one alignment. Windows with the item's own values in their slots always count.
Of the others those count that agree with the alignment's mapping: each of the item's slots
goes to the value that most windows give it. Mentions of a name are one slot; equal numbers are one
slot only before the same word, so that 12 loaves and 12 cakes may part.

A document is contaminated by an item if enough of the item's windows count, whatever the values
in the slots. An item of under LEAST_TOKENS words is found in whole lines alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regdelta.llm.common import cut, python_tasks, table, tidy

WINDOW = 8
#: Words that a window needs besides placeholders; windows with fewer are hashed as they stand.
LEAST_WORDS = 4
#: Items of fewer words are compared with whole lines, as they stand.
LEAST_TOKENS = 5
#: Most capitals in a row that are read as one name.
LONGEST_NAME = 4
#: Share of an item's windows that must be found.
COVERAGE = 0.5
#: Most benchmark windows that are sent to the tasks at once; larger benchmarks go in blocks.
BLOCK_WINDOWS = 1 << 21
#: Most benchmark windows with their slots, or rows to be dropped, whose join is broadcast.
BROADCAST_ROWS = 1 << 17

#: What a token is; `Characters.split` gives the same.
TOKEN = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}'’]*|[.!?\n]|[%$€£°]")
UNITS = frozenset(
    "m km cm mm mi ft yd inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kg g mg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons tonnes ounce ounces l ml liter liters litre litres "
    "gallon gallons cup cups s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kph percent cent cents dollar dollars euro euros usd eur gbp degree degrees celsius fahrenheit watt watts volt volts "
    "% $ € £ °".split()
)
# fixed values: numerals of English, German, French and Spanish; the German and Spanish ones of two parts follow from a rule. Numerals that are
# articles as well (ein, une, uno and their like) are words
_UNITS_OF_GERMAN = "ein zwei drei vier fünf sechs sieben acht neun".split()
_TENS_OF_GERMAN = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
NUMERALS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred hundreds thousand thousands million millions billion billions dozen dozens "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn hundert tausend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte "
    "treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos quinientos mil".split()
) | {*_TENS_OF_GERMAN, *(f"{u}und{t}" for u in _UNITS_OF_GERMAN for t in _TENS_OF_GERMAN)} | {f"veinti{u}" for u in "uno dós trés cuatro cinco séis siete ocho nueve".split()}
WORD, CAPITAL, NUMBER, NUMERAL, UNIT, END, BREAK = range(7)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Numerals in a row that are one number; the next ones are another.
LONGEST_NUMBER = 16
#: Factors of the tokens of a name or number, by their place in it.
POWERS = np.array([pow(int(FACTOR), k, 1 << 64) for k in range(max(LONGEST_NAME, LONGEST_NUMBER))], np.uint64)
HOLDERS = np.array([0, 0x6E616D65AAAA, 0x6E756DBBBB, 0x756E6974CCCC], np.uint64)
# bits of a character's class; a character without any is part of no token
LETTER, JOIN, DIGIT, POINT, ALONE, ODD = 1, 2, 4, 8, 16, 32
#: Characters that are split at once, more where a token is longer; texts of about half as many are laid end to end.
PIECE = 1 << 19
#: Places in a token whose factors are kept.
FIRST_PLACES = 1 << 10


def _mixed(x: np.ndarray) -> np.ndarray:
    """The numbers with their bits mixed (the last steps of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Characters:
    """For every code point the class, the kind of a token that begins with it, and a number for its lower case; odd factors for places in a token.

    The hash of a token is the sum of the numbers of its characters, each times the factor of its place.
    """

    def __init__(self):
        every = "".join(map(chr, range(0x110000)))
        self.classes, self.kinds = np.zeros(len(every), np.uint8), np.full(len(every), WORD, np.int8)
        for pattern, bit in ((r"\p{L}+", LETTER), (r"[\p{M}'’]+", JOIN), (r"\p{N}+", DIGIT), ("[.,]+", POINT), (r"[.!?\n%$€£°]+", ALONE)):
            for run in regex.finditer(pattern, every):
                self.classes[run.start() : run.end()] |= bit
        for at in np.flatnonzero(self.classes & (LETTER | DIGIT)).tolist():
            c = every[at]
            self.kinds[at] = NUMBER if c.isnumeric() else CAPITAL if c.isupper() else WORD
        self.kinds[[ord(c) for c in ".!?"]], self.kinds[ord("\n")] = END, BREAK
        # the lower case of these depends on what stands beside it, or is two characters: their tokens are hashed one by one
        odd = "\u0130\u03a3"
        self.classes[[ord(c) for c in odd]] |= ODD
        for c in odd:
            every = every.replace(c, " ")
        lower = np.frombuffer(every.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.numbers = _mixed((lower + np.uint64(1)) * FACTOR)
        self.factors = self._factors(FIRST_PLACES)
        codes = {self.code(x): kind for words, kind in ((UNITS, UNIT), (NUMERALS, NUMERAL)) for x in words}
        self.listed = np.array(sorted(codes), np.uint64)
        self.listed_kinds = np.array([codes[x] for x in self.listed.tolist()], np.int8)
        self.begins = np.zeros(1 << 16, bool)
        self.begins[self.listed >> np.uint64(48)] = True

    @staticmethod
    def _factors(places: int) -> np.ndarray:
        return _mixed((np.arange(places, dtype=np.uint64) + np.uint64(1 << 32)) * FACTOR) | np.uint64(1)

    def factors_of(self, places: int) -> np.ndarray:
        """Factors for so many places; those of longer tokens than usual are not kept."""
        return self.factors if places <= FIRST_PLACES else self._factors(places)

    def code(self, token: str) -> int:
        """The hash of one token, as `split` has it for tokens in a text."""
        c = np.frombuffer(token.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return int(_mixed((self.numbers[c] * self.factors_of(len(c))[: len(c)]).sum(keepdims=True))[0])

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end, hash and kind of the matches of TOKEN in a text."""
        out, low, size = [], 0, PIECE
        while low < len(text):
            c = np.frombuffer(text[low : low + size].encode("utf-32-le", "surrogatepass"), np.uint32)
            classes = self.classes[c]
            if low + size < len(text):
                # a piece ends where no token can cross
                free = np.flatnonzero(classes == 0)
                if not len(free):
                    size *= 2
                    continue
                c, classes = c[: free[-1] + 1], classes[: free[-1] + 1]
            begin, end, code, kind = self._split(c, classes)
            for i in np.unique(np.searchsorted(begin, np.flatnonzero(classes & ODD), "right") - 1).tolist():
                code[i] = self.code(text[low + begin[i] : low + end[i]])
            out.append((begin + low, end + low, code, kind))
            low, size = low + len(c), PIECE
        if not out:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)))
        begin, end, code, kind = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*out))
        at = np.flatnonzero(self.begins[code >> np.uint64(48)])
        which = np.minimum(np.searchsorted(self.listed, code[at]), len(self.listed) - 1)
        own = (self.listed[which] == code[at]) & ((kind[at] == WORD) | (kind[at] == CAPITAL))
        kind[at[own]] = self.listed_kinds[which[own]]
        return begin, end, code, kind

    def _split(self, c: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(c)
        digit, word, alone = classes & DIGIT > 0, classes & (LETTER | JOIN) > 0, classes & ALONE > 0
        # a point or comma between digits is part of the number
        point = np.flatnonzero(classes & POINT)
        point = point[(point > 0) & (point < n - 1)]
        point = point[digit[point - 1] & digit[point + 1]]
        digit[point], alone[point] = True, False
        # marks and apostrophes with no letter before them are part of no word
        if (word[1:] & ~word[:-1] & (classes[1:] & LETTER == 0)).any() or (word[0] and not classes[0] & LETTER):
            places = np.arange(n)
            word &= np.maximum.accumulate(np.where(classes & LETTER, places, -1)) > np.maximum.accumulate(np.where(word, -1, places))
        group = word + 2 * digit.view(np.uint8) + 3 * alone.view(np.uint8)
        turns = alone.copy()
        turns[0] = True
        turns[1:] |= group[1:] != group[:-1]
        begin = np.flatnonzero(turns)
        lengths = np.diff(begin, append=n)
        token = group[begin] > 0
        terms = self.numbers[c]
        terms *= self.factors_of(int(lengths[token].max(initial=0)))[(np.arange(n) - np.repeat(begin, lengths)) * np.repeat(token, lengths)]
        code = np.add.reduceat(terms, begin)[token]
        begin = begin[token]
        return begin, begin + lengths[token], _mixed(code), self.kinds[c[begin]]


@functools.cache
def characters() -> Characters:
    return Characters()


class Canon:
    """Turns texts into templates: one, or several laid end to end."""

    def __init__(self):
        self.characters = characters()

    def __call__(self, *texts: str) -> "Text":
        # no token holds a zero character
        body = "\0".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin, end, code, kind = self.characters.split(body)
        return Text(body, begin, end, code, kind, np.searchsorted(begin, np.cumsum(lengths + 1) - lengths - 1))


class Text:
    """The tokens of texts laid end to end, marks of sentence and line ends apart, in two readings; they are one object where they do not differ.

    bounds: where each text begins among the words, and their number. two: whether the readings of each text differ.
    """

    def __init__(self, body: str, begin: np.ndarray, end: np.ndarray, code: np.ndarray, kind: np.ndarray, texts: np.ndarray):
        self.body = body
        places = np.flatnonzero(kind < END)
        self.begin, self.end, self.code, self.kind = begin[places], end[places], code[places], kind[places]
        self.bounds = np.append(np.searchsorted(places, texts), len(places))
        self.opens = np.zeros(len(places), bool)
        self.opens[self.bounds[:-1][self.bounds[:-1] < len(places)]] = True
        self.first = (kind[places - 1] >= END) | self.opens
        self.lines = np.cumsum(kind == BREAK)[places] + np.cumsum(self.opens)
        opening = (self.kind == CAPITAL) & self.first
        self.two = np.diff(np.append(0, np.cumsum(opening))[self.bounds]) > 0
        self.plain = self.read((self.kind == CAPITAL) & ~self.first)
        self.named = self.read(self.kind == CAPITAL) if opening.any() else self.plain

    def __len__(self) -> int:
        return len(self.begin)

    def read(self, name: np.ndarray) -> "Template":
        """The reading in which these tokens are names or parts of names."""
        n, numeral = len(self), self.kind == NUMERAL
        number = numeral | (self.kind == NUMBER)
        if not n or (not name.any() and not number.any()):
            return Template(self, np.arange(n), self.code, self.code, np.zeros(n, bool))
        goes_on = np.zeros(n, bool)
        goes_on[1:] = name[1:] & name[:-1] & ~self.first[1:]
        folds = goes_on.any()
        if folds:
            heads = np.flatnonzero(~goes_on)
            lengths = np.diff(heads, append=n)
            if (lengths > LONGEST_NAME).any():
                heading = np.repeat(lengths > LONGEST_NAME, lengths)
                name, goes_on = name & ~heading, goes_on & ~heading
                folds = goes_on.any()
        if numeral.any():
            more = np.zeros(n, bool)
            more[1:] = numeral[1:] & number[:-1] & ~self.first[1:]
            heads = np.flatnonzero(~more)
            more &= (np.arange(n) - np.repeat(heads, np.diff(heads, append=n))) % LONGEST_NUMBER != 0
            goes_on |= more
            folds = folds or more.any()
        hold = name.view(np.int8) + 2 * number.view(np.int8)
        # a unit stands by its number
        if number.any():
            beside = np.zeros(n, bool)
            beside[1:] = number[:-1] & ~self.opens[1:]
            beside[:-1] |= number[1:] & ~self.opens[1:]
            hold[(self.kind == UNIT) & beside] = 3
        code, at = self.code, np.arange(n)
        if folds:
            at = np.flatnonzero(~goes_on)
            code = np.add.reduceat(code * POWERS[np.arange(n) - np.repeat(at, np.diff(at, append=n))], at)
            hold = hold[at]
        held = hold > 0
        template = code.copy()
        template[held] = HOLDERS[hold[held]]
        return Template(self, at, code, template, held)

    def short_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the lines of under LEAST_TOKENS words."""
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        starts = np.flatnonzero(np.diff(self.lines, prepend=-1))
        lengths = np.diff(starts, append=len(self))
        for size in range(1, LEAST_TOKENS):
            own = starts[lengths == size]
            h = np.full(len(own), size + 2000, np.uint64)
            for k in range(size):
                h = h * FACTOR + self.code[own + k]
            places.append(own)
            hashes.append(h)
        return np.concatenate(places), np.concatenate(hashes)


class Template:
    """Template tokens of one reading: where each begins in the text, its plain and template hash, whether it is a placeholder."""

    def __init__(self, text: Text, at: np.ndarray, plain: np.ndarray, template: np.ndarray, held: np.ndarray):
        self.text, self.at, self.plain, self.template, self.held = text, at, plain, template, held

    def __len__(self) -> int:
        return len(self.at)

    def value(self, i: int) -> str:
        start = self.at[i]
        end = self.at[i + 1] if i + 1 < len(self.at) else len(self.text)
        return " ".join(self.text.body[a:b] for a, b in zip(self.text.begin[start:end].tolist(), self.text.end[start:end].tolist())).lower()

    def values(self, start: int, size: int) -> list[str]:
        """Values of the placeholders of a window."""
        return [self.value(i) for i in range(start, start + size) if self.held[i]]

    def slots(self, start: int, size: int) -> list[dict]:
        """Values of a window's placeholders with the slot each belongs to: names and units by themselves, numbers by the next word too. For one text alone."""
        out = []
        for i in range(start, start + size):
            if self.held[i]:
                own = self.value(i)
                number = self.text.kind[self.at[i]] in (NUMBER, NUMERAL)
                out.append({"slot": f"{own} {self.value(i + 1)}" if number and i + 1 < len(self) else own, "own": own})
        return out


def windows(t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that starts at each token, and whether it is compared as it stands; of several texts also windows that begin in one and end in another."""
    n = len(t) - size + 1
    if n < 1:
        return np.array([], np.uint64), np.array([], bool)
    h = np.full(n, size + 1000, np.uint64)
    for k in range(size):
        h *= FACTOR
        h += t.template[k : k + n]
    if not t.held.any():
        return h, np.zeros(n, bool)
    holders = np.zeros(len(t) + 1, np.int32)
    np.cumsum(t.held, out=holders[1:])
    stands = size - (holders[size:] - holders[:-size]) < min(LEAST_WORDS, size)
    own = np.flatnonzero(stands)
    if len(own):
        plain = np.full(len(own), size, np.uint64)
        for k in range(size):
            plain *= FACTOR
            plain += t.plain[own + k]
        h[own] = plain
    return h, stands


ITEM_ROW = "item string, item_key long, at int, place int, total int, size int, h long, slots array<struct<slot:string,own:string>>, named boolean"
HIT_ROW = "doc string, key long, at int, h long, got array<string>, reading boolean"
ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "array<struct<slot:string,own:string>>": pa.list_(pa.struct([("slot", pa.string()), ("own", pa.string())])),
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ", 1) for f in regex.split(r",(?![^<]*>)", schema)]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _key(text: str) -> int:
    """What Spark's xxhash64 gives for the text."""
    return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))


def _name(id_col: str) -> Column:
    """An id as text, empty for a null one: a key that is never null."""
    return F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """ITEM_ROW: windows of every item in both readings, place being the word they begin with and total the number of places.

    An item of fewer template tokens than a window is one window; one of under LEAST_TOKENS words is one line (size 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            out = []
            for item, body in zip(b.column("item").to_pylist(), b.column("body").to_pylist()):
                text = canon(body or "")
                if not len(text):
                    continue
                key = _key(body)
                if len(text) < LEAST_TOKENS:
                    text.lines[:] = 0
                    out += [(item, key, 0, 0, 1, 0, h, [], False) for h in text.short_lines()[1].view(np.int64).tolist()]
                    continue
                own = []
                for named, t in ((False, text.plain), (True, text.named)):
                    size = min(WINDOW, len(t))
                    h, stands = windows(t, size)
                    own += [(i, int(t.at[i]), size, x, [] if stands[i] else t.slots(i, size), named) for i, x in enumerate(h.view(np.int64).tolist())]
                total = len({place for _, place, *_ in own})
                out += [(item, key, i, place, total, *rest) for i, place, *rest in own]
            yield _batch(out, ITEM_ROW)

    return benchmark.select(_name(id_col).alias("item"), F.col(text_col).alias("body")).mapInArrow(tidy(run), ITEM_ROW)


def _document_windows(rows: DataFrame, sorted_hashes: np.ndarray, sizes: list[int]) -> DataFrame:
    """HIT_ROW: the windows of whole documents whose hash is one of those given, and their short lines for size 0.

    reading: named or not; null where the text has one reading for both.
    """
    held_hashes = rows.sparkSession.sparkContext.broadcast(sorted_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, known = Canon(), held_hashes.value
        begins = np.zeros(1 << 20, bool)
        begins[known >> np.uint64(44)] = True

        def lookup(h: np.ndarray) -> np.ndarray:
            """Places of the hashes that are known; few are looked for whose first bits no known one has."""
            at = np.flatnonzero(begins[h >> np.uint64(44)])
            return at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]

        def hits(bodies: list[str]) -> Iterator[tuple]:
            """(text, at, h, got, reading), text being a number."""
            text = canon(*bodies)
            for size in sizes:
                if not size:
                    places, h = text.short_lines()
                    found = lookup(h)
                    owner = np.searchsorted(text.bounds, places[found], "right") - 1
                    at = places[found] - text.bounds[owner]
                    yield from ((o, i, x, [], None) for o, i, x in zip(owner.tolist(), at.tolist(), h[found].view(np.int64).tolist()))
                    continue
                for t in (text.plain,) if text.named is text.plain else (text.plain, text.named):
                    h, stands = windows(t, size)
                    found = lookup(h)
                    bounds = np.searchsorted(t.at, text.bounds)
                    owner = np.searchsorted(bounds, found, "right") - 1
                    own = found + size <= bounds[owner + 1]
                    if t is text.named and t is not text.plain:
                        own &= text.two[owner]
                    found, owner = found[own], owner[own]
                    for i, o, at, x in zip(found.tolist(), owner.tolist(), (found - bounds[owner]).tolist(), h[found].view(np.int64).tolist()):
                        yield o, at, x, [] if stands[i] else t.values(i, size), t is text.named if text.two[o] else None

        for b in batches:
            out = []
            docs, bodies = b.column("doc").to_pylist(), [x or "" for x in b.column("body").to_pylist()]
            # short texts are laid end to end
            ends = np.cumsum([len(x) for x in bodies]) // (PIECE // 2)
            for part in np.split(np.arange(len(bodies)), np.flatnonzero(np.diff(ends)) + 1) if bodies else ():
                start, keys = int(part[0]), {}
                for o, *hit in hits(bodies[start : start + len(part)]):
                    if o not in keys:
                        keys[o] = _key(bodies[start + o])
                    out.append((docs[start + o], keys[o], *hit))
            yield _batch(out, HIT_ROW)

    return rows.mapInArrow(tidy(run), HIT_ROW)


def _with_prefixes(items: DataFrame, coverage: float) -> DataFrame:
    """Adds rare: whether the window is at one of the places of its item that the fewest other items share.

    A document that holds `need` of an item's `total` places holds one of any total - need + 1
    of them; these are the rarest, so that what thousands of items share brings up none of them.
    """
    shared = items.groupBy("h").agg(F.count("*").alias("n"))
    places = items.join(shared, "h").groupBy("item", "item_key", "total", "place").agg(F.max("n").alias("n"))
    need = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(coverage) - F.lit(1e-9)))
    rank = F.row_number().over(Window.partitionBy("item", "item_key").orderBy("n", "place"))
    flags = places.select("item", "item_key", "place", (rank <= F.col("total") - need + 1).alias("rare"))
    return items.join(flags, ["item", "item_key", "place"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, item_id, found, total, coverage, verbatim: one row per contaminated document text and item.

    found of the item's `total` places begin a window that counts. verbatim: enough of them
    have the item's own values; otherwise the question was re-parameterised. key is a hash
    of the text: rows that repeat id and text give one row, a repeated id with another
    text a row of its own; of an item id with several texts the best covered counts. Null and
    empty texts and items, and items without a word, have no windows and match nothing. An item
    of under LEAST_TOKENS words matches lines that hold these words alone.
    Null ids are kept. An empty input or benchmark gives an empty result. Texts are read
    whole. Other columns are not read.

    Hashes of the benchmark's windows go to the tasks in blocks of at most BLOCK_WINDOWS;
    what is shuffled is the windows that hit, grouped by document and item. Items are
    brought up by their rarest windows alone, then compared in all.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    items = cut(_with_prefixes(cut(item_windows(benchmark), "windows").distinct(), coverage), "items")
    total = items.count()
    rows = docs.select(_name(id_col).alias("doc"), F.col(text_col).alias("body"))
    hits = None
    blocks = max(1, -(-total // BLOCK_WINDOWS))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod("h", F.lit(blocks)) == i)
        hashes = np.unique(part.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64))
        if len(hashes):
            found = _document_windows(rows, hashes, sizes)
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, key long, item_id long, found long, total int, coverage double, verbatim boolean")
    hits = cut(hits, "hits")
    known = items.select("item", "item_key", F.col("at").alias("item_at"), "place", "total", "h", "named", "slots", "rare")
    sized = F.broadcast if total <= BROADCAST_ROWS else lambda x: x
    same_reading = "reading is null or reading = named"
    brought = hits.select("doc", "key", "h", "reading").join(sized(known.where("rare").select("h", "named", "item", "item_key")), "h").where(same_reading)
    candidates = cut(brought.select("doc", "key", "item", "item_key").distinct(), "candidates")
    pairs = hits.join(candidates, ["doc", "key"]).join(sized(known.drop("rare")), ["item", "item_key", "h"]).where(same_reading)

    # slots of both sides stand in one order. Windows that are compared as they stand have none
    one = ["doc", "key", "item", "item_key", "total", "named", "diagonal"]
    filled = F.zip_with("slots", "got", lambda a, b: F.struct(a["slot"].alias("slot"), a["own"].alias("own"), b.alias("got")))
    placed = pairs.withColumn("diagonal", F.col("at") - F.col("item_at")).withColumn("s", filled)
    aligned = cut(placed.groupBy(*one, "place").agg(F.first("s").alias("s")), "aligned")
    votes = aligned.select(*one, F.explode(F.array_distinct("s")).alias("v")).where("v.slot is not null").groupBy(*one, "v.slot", "v.own", "v.got").agg(F.count("*").alias("n"))
    chosen = votes.groupBy(*one, "slot").agg(F.max_by("got", F.struct("n", F.col("own") == F.col("got"), "got")).alias("got"))
    mapping = chosen.groupBy(*one).agg(F.map_from_entries(F.collect_list(F.struct("slot", "got"))).alias("m"))
    same = F.coalesce(F.forall("s", lambda x: x["own"] == x["got"]), F.lit(False)).alias("same")
    agrees = F.coalesce(F.forall("s", lambda x: F.col("m")[x["slot"]] == x["got"]), F.lit(False))
    counted = aligned.join(mapping, one, "left").select(*one, "place", same, agrees.alias("agrees")).where("same or agrees")
    covered = counted.groupBy("doc", "key", "item", "item_key", "total").agg(
        F.countDistinct("place").alias("found"), F.countDistinct(F.when(F.col("same"), F.col("place"))).alias("exact")
    )
    best = covered.withColumn("coverage", F.col("found") / F.col("total")).where(F.col("coverage") >= coverage)
    best = best.groupBy("doc", "key", "item").agg(F.max_by(F.struct("found", "exact", "total", "coverage"), F.struct("coverage", "exact", "total")).alias("b"))
    return best.select(
        F.nullif("doc", F.lit("")).cast("long").alias("doc_id"), "key", F.nullif("item", F.lit("")).cast("long").alias("item_id"),
        "b.found", "b.total", "b.coverage", (F.col("b.exact") / F.col("b.total") >= coverage).alias("verbatim"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, all their columns. A row is known by its id and a hash of its text.

    What goes is counted first: up to BROADCAST_ROWS rows of it are sent to the texts, more are joined as Spark sees fit.
    """
    bad = cut(contaminated(docs, benchmark, coverage, id_col, text_col).select(F.col("doc_id").alias("_bad"), F.col("key").alias("_key")).distinct(), "bad")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    # the key is what Spark's xxhash64 gives for the text
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("_bad")) & (key == F.col("_key")), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("found").alias("found"), F.max("total").alias("total"), F.max("coverage").alias("coverage"), F.max("verbatim").alias("verbatim")
    )
