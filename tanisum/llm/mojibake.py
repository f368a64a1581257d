"""Garbled text from a wrong character encoding: noisy-channel detection and repair.

A channel is a pair of encodings: the bytes a text was written in, and how they
were read. Each suspicious token becomes a lattice of bytes under every channel
that can have produced it, with wildcards where bytes were lost (a replacement
character, or a question mark inside a word). A Viterbi search over the lattice
segments what was written into words and symbols under their document
frequencies in the whole corpus; where the best reading beats the text as it
stands, the token is damaged and the reading is its repair.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Words kept by name, the most frequent first. Two rows of SKETCH counters tell which others there can be; their counts are joined to the texts that need them.
LEXICON, SKETCH = 200_000, 1 << 20
#: Words in this share of the documents, and FLOOR more, need no search.
USUAL, FLOOR = 0.005, 20
#: Half-read tokens that are kept while a token's runs are read through different channels.
BEAM = 16
#: Share of the documents from which a symbol is ordinary.
COMMON = 0.05
#: Share of the documents below which a character isn't taken for one that was written.
RARE = 5e-4
#: Distinct tokens remembered by a worker.
MEMORY = 500_000

_CUT = r"\x00-\x20!\"#$%&()*+,./:;<=>@\[\\\]^_`{|}~\x7f"
_TOKEN = re.compile(rf"[^{_CUT}]*[^\x00-\x7f][^{_CUT}]*")
_LOST = re.compile(r"(?<![^\s\"'(\[>}-])\?(?=[A-Za-z])[A-Za-z']+|[A-Za-z']+(?:\?+[A-Za-z']+)+|(?m:^[-\s]*\?(?=\s))")
_EDGE = "'-?"

# fixed values: encodings that subtitle files are written in and read with
_READ = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "koi8-r")
_WRITTEN = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp857", "cp866", "cp737", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "koi8-r")


def _characters(encoding: str) -> list[str]:
    """The character of each byte; bytes the encoding leaves undefined stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_CHARS = {e: _characters(e) for e in _WRITTEN}
_BYTES = {e: {c: b for b, c in reversed(list(enumerate(_characters(e))))} for e in _READ}
#: As byte characters, and straight to what another encoding makes of the bytes, for str.translate.
_AS_BYTES = {e: {ord(c): chr(b) for c, b in _BYTES[e].items()} for e in _READ}
_ACROSS = {(r, w): {ord(c): _CHARS[w][b] for c, b in _BYTES[r].items()} for r in _READ for w in _WRITTEN if r != w}


def _as_utf8(token: str, read: str) -> str | None:
    """The token's bytes under an encoding that has all its characters, as UTF-8."""
    try:
        return token.translate(_AS_BYTES[read]).encode("latin-1").decode()
    except UnicodeError:
        return None


# fixed values: symbols that may stand right before, and right after, a letter
_OPENING = "“„‘«‹¿¡♪\ufeff"
_CLOSING = "”“’»›…♪"
#: Stands for any one lost character.
WILD = "�"


#: Begins what is asked about a word with wildcards.
_PATTERN = "\x00"


def _spots(w: str) -> tuple[int, int]:
    """The counters of a word in the two rows of the sketch."""
    raw = w.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) & (SKETCH - 1), zlib.crc32(raw, 0x5BD1E995) & (SKETCH - 1)


class Lexicon:
    """Document frequencies of words with characters beyond ASCII, and of symbols."""

    def __init__(self, words: dict[str, int], symbols: dict[str, int], docs: int, others: np.ndarray | None = None):
        self.words, self.symbols, self.docs, self.others = words, symbols, max(1, docs), others
        self.least = 0 if others is None else min(words.values(), default=0)
        #: What is known of words that aren't kept by name, what isn't but is needed (None: take the counters' word), and how often it was needed.
        self.more: dict[str, tuple[int, str]] = {}
        self.missing: set[str] | None = None
        self.unknown = 0
        self.usual = FLOOR + USUAL * self.docs
        self.shapes: dict[str, list[str]] = {}
        for w in words:
            if WILD not in w:
                self.shapes.setdefault(_shape(w), []).append(w)
        self.common = {c for c, n in symbols.items() if n >= COMMON * self.docs and not c.isalpha()}
        self.strip = "".join(self.common) + _EDGE
        # what may be written: ASCII, symbols and the letters of one script, none of them rarer than RARE
        usual = [c for c, n in symbols.items() if n >= RARE * self.docs and not "\x80" <= c <= "\xa0"]
        signs = "".join(c for c in usual if not c.isalpha()) + WILD
        scripts: dict[str, str] = {}
        for c in usual:
            if c.isalpha():
                name = unicodedata.name(c, "").split(" ")[0]
                scripts[name] = scripts.get(name, "") + c
        kinds = [f"[\\x00-\\x7f{re.escape(signs + letters)}]*" for letters in scripts.values()] or [f"[\\x00-\\x7f{re.escape(signs)}]*"]
        self.plausible = re.compile("|".join(kinds))
        self.known: dict[str, tuple[str, bool, tuple[str, str] | None]] = {}
        self.bad: dict[str, bool] = {}

    def count(self, w: str) -> int:
        """Documents with a word; of one that isn't known yet, maybe too many."""
        n = self.words.get(w)
        if n is None:
            n = 0 if self.others is None else int(min(self.others[k, at] for k, at in enumerate(_spots(w))))
            if n and self.missing is not None:
                got = self.more.get(w)
                if got is not None:
                    return got[0]
                self.need(w)
        return n

    def need(self, key: str) -> None:
        self.unknown += 1
        self.missing.add(key)

    def word(self, w: str) -> float:
        return math.log((self.count(w) + 0.05) / self.docs)

    def symbol(self, c: str) -> float:
        return math.log((self.symbols.get(c, 0) + 0.05) / self.docs)

    def lost(self, w: str) -> tuple[float, str] | None:
        """The most frequent word that fits a word with wildcards."""
        fits = [v for v in self.shapes.get(_shape(w), ()) if all(a in (WILD, b) for a, b in zip(w, v, strict=True))]
        best = max(((self.word(v), v) for v in fits), default=None)
        # a word that isn't kept by name may be as frequent as the least one that is
        if self.missing is not None and self.others is not None and (best is None or self.words[best[1]] <= self.least):
            got = self.more.get(_PATTERN + w)
            if got is None:
                self.need(_PATTERN + w)
            else:
                best = (math.log((got[0] + 0.05) / self.docs), got[1]) if got[0] else None
        return best


def _shape(w: str) -> str:
    return "".join(c if c < "\x80" else "*" for c in w)


def _letter(c: str) -> bool:
    return c.isalpha() or c in "'’"


def _misplaced(left: str, c: str, right: str) -> bool:
    """Whether a symbol can't stand between these neighbours."""
    return (right.isalnum() and (c not in _OPENING or left.isalnum())) or (left.isalnum() and c not in _CLOSING)


def reading(units: str, lex: Lexicon) -> tuple[float, str]:
    """Best segmentation of a lattice path into words and symbols: log probability and text."""
    n = len(units)
    best: list[tuple[float, str]] = [(0.0, "")] + [(-math.inf, "")] * n
    for i in range(n):
        score, text = best[i]
        if score == -math.inf:
            continue
        c = units[i]
        options: list[tuple[int, float, str]] = []
        # one character: free in ASCII, else a symbol
        if c < "\x80":
            options.append((i + 1, 0.0 if not c.isalpha() else -1.0, c))
        elif c == WILD:
            options.append((i + 1, -9.0, c))
            if i == 0 or i == n - 1 or not (units[i - 1].isalnum() and units[i + 1].isalnum()):
                s = max(lex.common, key=lambda x: lex.symbols[x], default=None)
                if s is not None:
                    options.append((i + 1, -3.0, s))
        else:
            alien = "\x80" <= c <= "\xa0" or _misplaced(units[i - 1 : i], c, units[i + 1 : i + 2])
            options.append((i + 1, -9.0 if c.isalpha() else lex.symbol(c) - (6.0 if alien else 0.0), c))
        # a word up to the end of the letters
        if (_letter(c) or c == WILD) and (i == 0 or not (_letter(units[i - 1]) or units[i - 1].isdigit())):
            j = i
            while j < n and (_letter(units[j]) or units[j] == WILD):
                j += 1
            if j < n and units[j].isdigit():
                j = i
            for end in {j, j - 1 if j > i and units[j - 1] == WILD else j} - {i}:
                w = units[i:end]
                if len(w) < 1 or not any(x >= "\x80" for x in w):
                    if w and w.isascii():
                        options.append((end, -1.0, w))
                    continue
                if WILD in w:
                    got = lex.lost(w.lower())
                    if got:
                        options.append((end, got[0] - 1.0, _cased(got[1], w)))
                else:
                    options.append((end, lex.word(w.lower()), w))
        for end, gain, piece in options:
            if score + gain > best[end][0]:
                best[end] = (score + gain, text + piece)
    return best[n]


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _decoded(data: list[int], encoding: str) -> str | None:
    """Written characters of a byte path; negative entries are lost bytes."""
    if encoding != "utf-8":
        table = _CHARS[encoding]
        return "".join(WILD if b < 0 else table[b] for b in data)
    out, run = [], bytearray()
    i = 0
    while i < len(data):
        if data[i] >= 0:
            run.append(data[i])
            i += 1
            continue
        # lost bytes stand in for the rest of a character begun, or for one of their own
        try:
            out.append(run.decode())
        except UnicodeDecodeError as e:
            if e.end != len(run):
                return None
            try:
                out.append(run[: e.start].decode())
            except UnicodeDecodeError:
                return None
        out.append(WILD)
        run = bytearray()
        while i < len(data) and (data[i] < 0 or 0x80 <= data[i] < 0xC0):
            i += 1
    try:
        out.append(run.decode())
    except UnicodeDecodeError:
        return None
    return "".join(out)


def paths(token: str) -> Iterator[tuple[str, tuple[str, str] | None]]:
    """What may have been written, one text for each channel that can give the token, and the channel."""
    seen = {token}
    lost = [c == WILD or (c == "?" and 0 < i < len(token) - 1) or (c == "?" and i == 0 and len(token) > 1) for i, c in enumerate(token)]
    if any(lost):
        plain = "".join(WILD if x else c for x, c in zip(lost, token, strict=True))
        if plain not in seen or WILD in token:
            seen.add(plain)
            yield plain, None
    letters = set(token)
    for read in _READ:
        table = _BYTES[read]
        if not any(lost):
            if not letters <= table.keys():
                continue
            first = _as_utf8(token, read)
            second = _as_utf8(first, read) if first is not None and set(first) <= table.keys() else None
            others = [(w, token.translate(_ACROSS[read, w])) for w in _WRITTEN if w != read]
        else:
            data = [-1 if x else table.get(c, -2) for x, c in zip(lost, token, strict=True)]
            if -2 in data:
                continue
            first = _decoded(data, "utf-8")
            again = [-1 if c == WILD else table.get(c, -2) for c in first or ""]
            second = None if first is None or -2 in again else _decoded(again, "utf-8")
            others = [(w, _decoded(data, w)) for w in _WRITTEN]
        # right, read wrongly twice, written in another encoding of one byte
        for written, got in (("utf-8", first), ("twice", second), *others):
            if got is not None and got not in seen:
                seen.add(got)
                yield got, (read, written)


#: What a channel costs, in log probability, and what damage in one token must gain beyond it.
PRIOR = 3.0


def _swapped(token: str, text: str, lex: Lexicon) -> float:
    """Cost of a path that turns letters beside others into symbols: letters misread otherwise look like that."""
    if len(token) != len(text):
        return 0.0
    n = 0
    for i, (a, b) in enumerate(zip(token, text, strict=True)):
        if a.isalpha() and b >= "\x80" and not b.isalpha() and b != WILD:
            n += token[i - 1 : i].isalnum() or (b not in lex.common and token[i + 1 : i + 2].isalnum())
    return 6.0 * n


_RUN = re.compile(r"[^\x00-\x7f]+")


def _several(token: str, own: float, lex: Lexicon) -> str | None:
    """The token as it was written, if its runs beyond ASCII came through different channels, or some through none.

    A lattice with the readings of each run as arcs, searched with a beam;
    only for tokens that can't have been written as they are.
    """
    runs = list(_RUN.finditer(token))
    if len(runs) < 2 or lex.plausible.fullmatch(token):
        return None
    heads: list[tuple[float, str, frozenset]] = [(0.0, token[: runs[0].start()], frozenset())]
    for k, run in enumerate(runs):
        after = token[run.end() : runs[k + 1].start() if k + 1 < len(runs) else len(token)]
        arcs = [(run.group(0), None), *((p, c) for p, c in paths(run.group(0)) if lex.plausible.fullmatch(p))]
        found: dict[str, tuple[float, str, frozenset]] = {}
        for _, head, used in heads:
            for text, channel in arcs:
                through = used if channel is None else used | {channel}
                whole = head + text + after
                score, read = reading(whole, lex)
                score -= PRIOR * len(through)
                if through and (whole not in found or score > found[whole][0]):
                    found[whole] = (score, read, through)
                elif not through:
                    found.setdefault(whole, (score, read, through))
        heads = [(s, w, u) for w, (s, _, u) in sorted(found.items(), key=lambda x: -x[1][0])[:BEAM]]
        best = max(found.values(), key=lambda x: x[0])
    return best[1] if best[2] and best[0] > own else None


def judge(token: str, lex: Lexicon) -> tuple[str, bool, tuple[str, str] | None]:
    """The token as it was written, whether it is damaged, and by which channel."""
    got = lex.known.get(token)
    if got is not None:
        return got
    before = lex.unknown
    core = token.strip(lex.strip)
    out: tuple[str, bool, tuple[str, str] | None] = (token, False, None)
    # words that are frequent as they stand need no search
    if (core or WILD in token) and not (core.isalpha() and lex.count(core.lower()) >= lex.usual):
        own, _ = reading(token, lex)
        best: tuple[float, str, tuple[str, str] | None] = (-math.inf, token, None)
        for p, channel in paths(token):
            if not lex.plausible.fullmatch(p):
                continue
            score, text = reading(p, lex)
            if score > best[0]:
                score -= _swapped(token, p, lex)
                if score > best[0]:
                    best = (score, text, channel)
        if best[0] - PRIOR > own:
            out = (best[1], True, best[2])
        elif (several := _several(token, own, lex)) is not None:
            out = (several, True, None)
        elif WILD in token or any("\x80" <= c <= "\x9f" for c in token):
            out = (token, True, None)
    if len(lex.known) < MEMORY and lex.unknown == before:
        lex.known[token] = out
    return out




def chunks(text: str) -> list[str]:
    """The text cut at ASCII white space only: other kinds may be part of a garbled token."""
    for c in "\n\r\t\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


_LOSS = re.compile(r"\?[A-Za-z']")


def _maybe_lost(text: str) -> bool:
    """A cheap sign that a question mark may stand for a lost character."""
    return "?" in text and ("\n?" in text or "\n- ?" in text or text[0] == "?" or _LOSS.search(text) is not None)


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a text that may be damaged."""
    found: set[str] = set()
    if not text.isascii():
        for w in set(chunks(text)):
            if not w.isascii():
                found.update(_TOKEN.findall(w))
    if _maybe_lost(text):
        found.update(t.strip() for t in _LOST.findall(text))
    return found


def damaged(text: str, lex: Lexicon) -> bool:
    """Whether any token of the text is damaged."""
    if not text.isascii():
        bad = lex.bad
        for w in set(chunks(text)):
            if w.isascii():
                continue
            got = bad.get(w)
            if got is None:
                before = lex.unknown
                got = any(judge(t, lex)[1] for t in _TOKEN.findall(w))
                if len(bad) < MEMORY and lex.unknown == before:
                    bad[w] = got
            if got:
                return True
    return _maybe_lost(text) and any(judge(t.strip(), lex)[1] for t in _LOST.findall(text))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    known: dict[str, list[str]] = {}
    docs = 0
    schema = pa.schema([("w", pa.string()), ("n", pa.int64())])

    def flush() -> pa.RecordBatch:
        keep = [w for w in words if w.isascii() or "\ud800" not in w]
        return pa.RecordBatch.from_pydict({"w": keep, "n": [words[w] for w in keep]}, schema=schema)

    for b in batches:
        for text in b.column("text").to_pylist():
            docs += 1
            if text is None or text.isascii():
                continue
            mine: set[str] = set()
            for w in set(chunks(text)):
                if not w.isascii():
                    got = known.get(w)
                    if got is None:
                        got = []
                        for t in _TOKEN.findall(w):
                            core = t.strip("'-?“”„‘’…—–♪€«»¿¡‹›").lower()
                            if core and not core.isascii():
                                got.append(core)
                        got += ["\x00" + c for c in set(w) if c >= "\x80"]
                        if len(known) < MEMORY:
                            known[w] = got
                    mine.update(got)
            words.update(mine)
        if len(words) > 1_000_000:
            yield flush()
            words.clear()
    words["\x00"] += docs
    yield flush()


def _word_counts(docs: DataFrame) -> DataFrame:
    """``w``, ``n``: documents (column text) with each word, and with each symbol after \\x00; their number under \\x00 alone."""
    counts = docs.select("text").mapInArrow(_counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return materialize(counts, "words")


def lexicon(docs: DataFrame) -> Lexicon:
    """Frequencies over all documents (column text): LEXICON words by name and two rows of SKETCH counters come to the driver."""
    return _lexicon(_word_counts(docs))


def _lexicon(counts: DataFrame) -> Lexicon:
    rest = counts.count() > LEXICON
    top = counts.orderBy(F.col("w").startswith("\x00").desc(), F.desc("n"), "w").limit(LEXICON) if rest else counts
    words, symbols, n = {}, {}, 0
    for r in top.toLocalIterator():
        if r["w"] == "\x00":
            n = r["n"]
        elif r["w"][0] == "\x00":
            symbols[r["w"][1:]] = r["n"]
        else:
            words[r["w"]] = r["n"]
    return Lexicon(words, symbols, n, _sketch(counts) if rest else None)


def _sketch(counts: DataFrame) -> np.ndarray:
    """Two rows of counters with the words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = np.array([_spots(w) for w in b.column("w").to_pylist()], np.int64).reshape(-1, 2)
            n = b.column("n").to_numpy()
            at = np.concatenate([spots[:, 0], spots[:, 1] + SKETCH])
            spot, inv = np.unique(at, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(np.bincount(inv, np.concatenate([n, n])).astype(np.int64))], names=["at", "n"])

    got = counts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * SKETCH, np.uint32)
    out[got["at"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**32 - 1)
    return out.reshape(2, SKETCH)


def _through(token: str, channel: tuple[str, str]) -> str | None:
    """The token as written, if it went through the channel and comes out as letters."""
    table = _BYTES[channel[0]]
    data = [table.get(c, -2) for c in token]
    if -2 in data:
        return None
    got = _decoded(data, "utf-8" if channel[1] == "twice" else channel[1])
    if channel[1] == "twice" and got is not None:
        data = [table.get(c, -2) for c in got]
        got = None if -2 in data else _decoded(data, "utf-8")
    return got if got is not None and all(c < "\x80" or c.isalpha() for c in got) else None


def repaired(text: str, lex: Lexicon) -> tuple[str, int]:
    """The text with damaged tokens restored, and their number.

    Words of a damaged line that the corpus hardly knows follow the line's
    most frequent channel.
    """
    n = 0

    def line_of(line: str) -> str:
        nonlocal n
        found = [judge(t, lex) for t in tokens_of(line)]
        if not any(bad for _, bad, _ in found):
            return line
        channels = Counter(c for _, bad, c in found if bad and c is not None)
        channel = max(channels, key=lambda c: (channels[c], c)) if channels else None

        def swap(m: re.Match) -> str:
            nonlocal n
            got, bad, _ = judge(m.group(0), lex)
            if not bad and channel is not None and not m.group(0).isascii() and lex.count(m.group(0).strip(lex.strip).lower()) < lex.usual:
                other = _through(m.group(0), channel)
                if other is not None and other != got:
                    got, bad = other, True
            n += bad
            return got

        line = _TOKEN.sub(swap, line)
        return _LOST.sub(swap, line) if "?" in line else line

    return "\n".join(map(line_of, text.split("\n"))), n


def _masked(b: pa.RecordBatch) -> pa.RecordBatch:
    """Words (w, n) with wildcards at the places (at)."""
    masked = []
    for w, at in zip(b.column("w").to_pylist(), b.column("at").to_pylist(), strict=True):
        c = list(w)
        for i in at:
            c[i] = WILD
        masked.append("".join(c))
    return pa.RecordBatch.from_arrays([pa.array(masked, pa.string()), b.column("n"), b.column("w")], names=["p", "n", "w"])


def _answers(needs: DataFrame, counts: DataFrame) -> DataFrame:
    """``key``, ``n``, ``w`` of everything that is asked (key): a word's count, or the most frequent word that fits a pattern; n is 0 where there is none."""
    words = counts.where(~F.col("w").startswith("\x00"))
    named = needs.where(~F.col("key").startswith(_PATTERN)).join(words, F.col("key") == F.col("w"), "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.col("key").alias("w"))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_pylist()
            at = [[i for i, c in enumerate(x) if c == WILD] for x in w]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_shape(x) for x in w], pa.string()), pa.array(at, pa.list_(pa.int32()))], names=[*b.schema.names, "shape", "at"])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_masked, batches)

    asked = needs.where(F.col("key").startswith(_PATTERN)).select(F.expr("substring(key, 2)").alias("p")).mapInArrow(shaped, "p string, shape string, at array<int>")
    whole = words.where(~F.col("w").contains(WILD)).mapInArrow(shaped, "w string, n long, shape string, at array<int>").drop("at")
    fits = whole.join(asked.select("shape", "at").distinct(), "shape").select("w", "n", "at").mapInArrow(masked, "p string, n long, w string")
    best = fits.groupBy("p").agg(F.max(F.struct("n", "w")).alias("best"))
    found = asked.select("p").join(best, "p", "left").select(F.concat(F.lit(_PATTERN), "p").alias("key"), F.coalesce("best.n", F.lit(0)).alias("n"), F.coalesce("best.w", F.lit("")).alias("w"))
    return named.unionByName(found)


_STATE = "id long, text string, n_damaged int, known array<struct<key: string, n: long, w: string>>, needs array<string>"


def _settled(rows: DataFrame, lex: Lexicon, counts: DataFrame) -> DataFrame:
    """As ``restored``, where words aren't all kept by name: texts wait for the counts they need, and are read again."""
    held = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            out = []
            for r in b.to_pylist():
                own.more = {k["key"]: (k["n"], k["w"]) for k in r["known"]}
                own.missing = set()
                fixed, n = repaired(r["text"], own) if damaged(r["text"], own) else (None, 0)
                if own.missing:
                    out.append((r["id"], r["text"], None, r["known"], sorted(own.missing)))
                elif fixed is not None:
                    out.append((r["id"], fixed, n, [], []))
            known = pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64()), ("w", pa.string())]))
            types = (pa.int64(), pa.string(), pa.int32(), known, pa.list_(pa.string()))
            cols = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["id", "text", "n_damaged", "known", "needs"])

    known = F.array().cast("array<struct<key: string, n: long, w: string>>")
    waiting = rows.select("id", "text", known.alias("known"))
    done = None
    while True:
        # the number is written with the row, so it stays the same
        state = materialize(waiting.mapInArrow(run, _STATE).withColumn("row", F.monotonically_increasing_id()), "judged")
        ready = state.where(F.size("needs") == 0).select("id", "text", "n_damaged")
        done = ready if done is None else done.unionByName(ready)
        waits = state.where(F.size("needs") > 0)
        if waits.isEmpty():
            return done
        needs = waits.select("row", F.explode("needs").alias("key"))
        told = needs.join(_answers(needs.select("key").distinct(), counts), "key")
        told = told.groupBy("row").agg(F.collect_list(F.struct("key", "n", "w")).alias("more"))
        waiting = waits.join(told, "row").select("id", "text", F.concat("known", "more").alias("known"))


def restored(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` as far as it can be restored and ``n_damaged`` tokens, of every record with damage.

    Null ids and texts are left out, empty texts have no damage; ids may
    repeat; other columns aren't read. Frequencies come from all records; of
    more than LEXICON words, those of the rarer ones are joined to the texts
    that need them, as often as new ones are needed.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    counts = _word_counts(rows)
    whole = _lexicon(counts)
    if whole.others is not None:
        return _settled(rows, whole, counts)
    lex = rows.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_damaged", pa.int32())])
        for b in batches:
            ids, texts, ns = [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not damaged(t, lex.value):
                    continue
                fixed, n = repaired(t, lex.value)
                ids.append(i)
                texts.append(fixed)
                ns.append(n)
            yield pa.RecordBatch.from_pydict({"id": ids, "text": texts, "n_damaged": ns}, schema=schema)

    return rows.mapInArrow(run, "id long, text string, n_damaged int")
