"""Exact token counts of every prefix of a text, by dynamic programming.

Byte-level byte-pair encoding cuts a text by a pattern and merges inside the cut pieces. Inside a piece, the encoding of a
prefix is that of a shorter prefix plus one last token; a token can follow another exactly if the two, encoded together,
stay the two. So one pass over the bytes finds the last token, and with it the count, of every prefix. Where the pattern
would cut a prefix differently from the whole text (white space that is followed by a word in the text but ends the
prefix; the letters of 're, 've, 'll; a special string not yet complete), the count is that of the prefix.

The counts are kept as one signed 16-bit step per character. They answer how many tokens a prefix has and which prefix
fits a budget, without encoding again. A worker keeps one table of chunks between blanks with the steps of their characters
and their token totals; each chunk is worked on once, and a batch's texts are put together from the table by array
operations. The table has a bound; when it is full the half that came last goes, as frequent chunks come early.

Defined cases: a null text is empty and has 0 tokens; special strings inside a text are special tokens, as the library
takes them by default; repeated rows are counted each; texts are read whole; an empty table gives an empty result; input
columns called like a result column give way to it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lessonlens.llm.batches import with_columns_of
from lessonlens.llm.tokenizing import load, vocabulary
from lessonlens.llm.words import flat

# Fixed value: the pattern of the vocabulary file's byte-level cut
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATE = {"'re", "'ve", "'ll"}
WHITE = {c for c in map(chr, range(0x3001)) if regex.match(r"\s", c)}
KEPT, LONGEST, SLICE = 500_000, 64, 256
BITS, MASK = 20, (1 << 20) - 1
STOPS = set(",.;:!?")
BEYOND_LATIN = "\u0250"  # letters before are letters in every version of Unicode


@dataclass(frozen=True)
class Counting:
    limit: int = 1024
    vocabulary: str = "byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Kept(dict):
    """A bounded store; ``make`` computes what is missing. The later half goes when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if not isinstance(key, str) or len(key) <= LONGEST:
            if len(self) >= KEPT:
                for k in list(self)[KEPT // 2:]:
                    del self[k]
            self[key] = value
        return value


class ChunkTable:
    """Chunks by number: where their steps lie in ``steps``, how many they are, and the tokens of each chunk."""

    def __init__(self, make):
        self.make, self.number = make, {}
        self.steps, self.begin, self.total = array("h"), array("q", [0]), array("l")

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """The numbers of distinct chunks; those of this call stay valid until the next one."""
        if len(self.number) > KEPT:
            half = KEPT // 2
            for chunk in list(self.number)[half:]:
                del self.number[chunk]
            del self.total[half:], self.steps[self.begin[half]:], self.begin[half + 1:]
        number, get = self.number, self.number.get
        out = list(map(get, chunks))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    steps = self.make(chunks[i].decode())
                    number[chunks[i]] = out[i] = len(self.total)
                    self.total.append(sum(steps))
                    self.steps.extend(steps)
                    self.begin.append(len(self.steps))
        return np.array(out, np.int64)


class PrefixCounter:
    kept: dict[str, "PrefixCounter"] = {}

    def __init__(self, path: str):
        tokenizer = load(path)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + ("|".join(map(re.escape, self.specials)) or "(?!)") + ")")
        self.letters = dict(enumerate(byte_letters()))
        plain = {letter: b for b, letter in self.letters.items()}
        vocabulary_ = tokenizer.get_vocab(with_added_tokens=False)
        self.token = {bytes([plain[c] for c in t]): i for t, i in vocabulary_.items() if all(c in plain for c in t)}
        self.spelled = dict(map(reversed, vocabulary_.items()))
        self.longest = max(map(len, self.token), default=1)
        self.size = [0] * (1 + max(vocabulary_.values(), default=0))
        for t, i in self.token.items():
            self.size[i] = len(t)
        self.tokens = ahocorasick.Automaton()
        for token in vocabulary_:
            self.tokens.add_word(token, (token, len(token)))
        self.tokens.make_automaton()
        self.follows = Kept(self._follows)
        self.known: dict[bytes, int] = {}  # prefix of a piece -> its count and its last token; with every prefix all shorter ones
        self.pieces = Kept(self._piece)
        self.chunks = ChunkTable(self._steps)
        self.cut = regex.compile(CUT)

    @classmethod
    def of(cls, path: str) -> "PrefixCounter":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _follows(self, pair: int) -> bool:
        """Whether two tokens, their numbers in one, stay the two when they are encoded together."""
        two = [self.spelled[pair >> BITS], self.spelled[pair & MASK]]
        return [t.value for t in self.model.tokenize("".join(two))] == two

    def _short(self, piece: bytes) -> list[int]:
        """Count of every byte prefix of a short piece. What a prefix has does not depend on what comes behind it, so pieces
        that begin alike share the work."""
        known, token, follows = self.known, self.token, self.follows
        if len(known) > KEPT:
            for k in list(known)[KEPT // 2:]:
                del known[k]
        done = len(piece)
        while done and piece[:done] not in known:
            done -= 1
        get, size = token.get, self.size
        last = known[piece[:done]] if done else 0
        for end in range(done + 1, len(piece) + 1):
            # exactly one last token follows what is before it; mostly it is the one before made longer, or a new byte
            begin = end - 1 - size[last & MASK] if end > 1 else 0
            first = begin
            new = get(piece[begin:end])
            if new is None or begin and not follows[(known[piece[:begin]] & MASK) << BITS | new]:
                for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    if begin != first and (new := get(piece[begin:end])) is not None and (
                            not begin or follows[(known[piece[:begin]] & MASK) << BITS | new]):
                        break
            last = ((known[piece[:begin]] >> BITS) + 1 if begin else 1) << BITS | new
            known[piece[:end]] = last
        return [known[piece[:end]] >> BITS for end in range(1, len(piece) + 1)]

    def _prefixes(self, piece: str) -> list[tuple[str, int]]:
        """Last token and count of every byte prefix of a long piece, the empty one included."""
        word = piece.encode().decode("latin-1").translate(self.letters)
        follows, number = self.follows, self.tokenizer.token_to_id
        row: list = [("", 0)] + [None] * len(word)
        for end, (token, size) in self.tokens.iter(word):  # all tokens that end at each place, the longest first
            if row[end + 1] is None:
                before = row[end + 1 - size]
                if size > end or follows[number(before[0]) << BITS | number(token)]:
                    row[end + 1] = (token, before[1] + 1)
        return row

    def _piece(self, piece: str) -> list[int]:
        """Token count of every prefix of a piece, one entry per character."""
        raw = piece.encode()
        counts = self._short(raw) if len(raw) <= LONGEST else [count for _, count in self._prefixes(piece)[1:]]
        if len(counts) == len(piece):
            return counts
        ends, at = [], -1
        for c in piece:
            at += len(c.encode())
            ends.append(counts[at])
        return ends

    def counts(self, text: str) -> list[int]:
        """Token count of every non-empty prefix of a text without special strings."""
        out: list[int] = []
        done, run, run_done = 0, 0, 0  # tokens before the piece; start of the white space before it, tokens before that
        pieces, after_white = self.pieces, False
        for match in self.cut.finditer(text):
            begin, piece = match.start(), match.group()
            own = pieces[piece]
            if not after_white:
                run, run_done = begin, done
            after_white = piece[-1] in WHITE
            if after_white:
                whole = own if run == begin else pieces[text[run:match.end()]][begin - run:]
                out.extend([run_done + c for c in whole])
            elif piece in LATE:
                out.extend((done + 1, done + 2, done + own[2]))
            else:
                out.extend([done + c for c in own])
                if run < begin and piece[0] == " ":
                    out[begin] = run_done + pieces[text[run:begin + 1]][-1]
            done += own[-1]
        return out

    def _steps(self, chunk: str) -> array:
        # mostly a chunk is a word behind a blank or a line break, with or without a mark: two or three pieces at most
        line, marked = chunk[:1] == "\n", chunk[-1:] in STOPS
        core = chunk[line:len(chunk) - marked]
        word = core[1:] if core[:1] == " " else core
        if word.isalpha() and max(word) < BEYOND_LATIN and not (line and core[0] == " "):
            counts = self._piece(core)
            if line:
                counts = [1, *[c + 1 for c in counts]]
            if marked:
                counts.append(counts[-1] + 1)
        else:
            counts = self.counts(chunk)
        return array("h", map(sub, counts, [0, *counts]))

    def total(self, text: str) -> int:
        return int(self.steps(text).sum(dtype=np.int64))

    def steps(self, text: str) -> np.ndarray:
        """The change of the count with every character; its running sum is the count of every prefix."""
        if not self.special.search(text):
            return np.array(self._steps(text) if text else [], "<i2")
        out, done = [np.zeros(0, np.int64)], 0
        parts = self.special.split(text)
        for plain, special in zip(parts[::2], [*parts[1::2], ""]):
            out.append(done + np.array(self.counts(plain + special[:-1]), np.int64))
            done += self.total(plain)
            if special:
                done += 1
                out.append(np.array([done]))
        return np.diff(np.concatenate(out), prepend=0).astype("<i2")

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a column of UTF-8 texts: the steps of all characters, the texts' borders in them, and tokens per text."""
        data, bounds = flat(column)
        lo, hi = int(bounds[0]), int(bounds[-1])
        own, part = bounds - lo, data[lo:hi]
        odd = {}  # texts with special strings or blanks after white space are worked on alone
        for i in range(len(own) - 1):
            text = part[own[i]:own[i + 1]].tobytes().decode()
            if SPACED.search(text) or self.special.search(text):
                odd[i] = self.steps(text)
        edge = np.zeros(len(part) + 1, bool)
        edge[:-1] = part == 32
        edge[1:-1] |= (part[1:] == 10) & ~BLANK[part[:-1]]  # a line break after a letter or mark begins a chunk as well
        edge[own] = True
        cuts = np.flatnonzero(edge)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(part)])
        begin = np.searchsorted(cuts, own)  # each text's first chunk
        usual = np.ones(len(cuts) - 1, bool)
        for i in odd:
            usual[begin[i]:begin[i + 1]] = False
        coded = (chunks if usual.all() else chunks.filter(pa.array(usual))).dictionary_encode()
        known = self.chunks.numbers(coded.dictionary.to_pylist())
        number = np.zeros(len(usual), np.int64)
        if len(known):
            number[usual] = known[coded.indices.to_numpy(zero_copy_only=False)]
        table, start = np.frombuffer(self.chunks.steps, "<i2"), np.frombuffer(self.chunks.begin, np.int64)
        size = np.where(usual, np.diff(start)[number] if len(start) > 1 else 0, 0)
        borders = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=borders[1:])
        source = np.repeat(start[number] - borders[:-1], size)
        source += np.arange(int(borders[-1]))
        steps = table[source]
        borders = borders[begin]
        if odd:
            pieces = [odd.get(i, steps[borders[i]:borders[i + 1]]) for i in range(len(own) - 1)]
            steps = np.concatenate(pieces)
            borders = np.cumsum([0, *map(len, pieces)])
        sums = np.zeros(len(steps) + 1, np.int64)
        np.cumsum(steps, out=sums[1:])
        return steps, borders, sums[borders[1:]] - sums[borders[:-1]]


SPACED = re.compile(r"\s ")
BLANK = np.ones(256, bool)  # bytes that may end white space
BLANK[0x21:0x7F] = False


def fitting(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _counted(docs: DataFrame, counting: Counting, keep: list[str], ddl: str) -> DataFrame:
    """The steps of every text, and of ``ddl`` what is asked for: the steps, their sum, their checksum, answers read from them."""
    wanted = [column.split()[0] for column in ddl.split(", ")]

    def make(batch: pa.RecordBatch) -> list[object]:
        counter = PrefixCounter.of(vocabulary(counting.vocabulary))
        out: dict[str, list] = {name: [] for name in wanted}
        column = batch.column(batch.num_columns - 1)
        for at in range(0, len(column), SLICE):
            steps, borders, totals = counter.batch(column.slice(at, SLICE))
            for a, b, total in zip(borders[:-1].tolist(), borders[1:].tolist(), totals.tolist()):
                own = steps[a:b]
                found = {"n_tokens": total, "prefix_steps": own.tobytes() if "prefix_steps" in out else None,
                         "steps_crc32": zlib.crc32(own) if "steps_crc32" in out else None,
                         "fitting_chars": b - a if "fitting_chars" in out and total <= counting.limit
                         else fitting(own, counting.limit) if "fitting_chars" in out else None}
                for name, values in out.items():
                    values.append(found[name])
        return list(out.values())

    return with_columns_of(docs, "text", ddl, make, keep)


def prefix_counts(docs: DataFrame, counting: Counting = Counting(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``prefix_steps``: the signed 16-bit steps of the count, a character each."""
    return _counted(docs, counting, docs.columns if keep is None else keep, "n_tokens long, prefix_steps binary")


def budget_answers(counted: DataFrame, budget: int, chars: int = 0) -> DataFrame:
    """From stored steps: ``fitting_chars``, the longest prefix within the budget, and ``prefix_tokens`` of the first ``chars``."""
    def make(batch: pa.RecordBatch) -> list[object]:
        steps = [np.frombuffer(s.as_buffer(), "<i2") for s in batch.column(batch.num_columns - 1)]
        return [[fitting(s, budget) for s in steps], [int(s[:chars].sum(dtype=np.int64)) for s in steps]]

    return with_columns_of(counted, "prefix_steps", "fitting_chars long, prefix_tokens long", make)


def count_report(docs: DataFrame, counting: Counting = Counting()) -> DataFrame:
    """The columns of the query, all read from the steps: their sum, the longest prefix within the limit, and a checksum of the
    steps as little-endian 16-bit numbers. The steps themselves stay in the task (``prefix_counts`` returns them)."""
    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    made = _counted(sized, counting, ["doc_id", "n_bytes"], "n_tokens long, fitting_chars long, steps_crc32 long")
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > counting.limit).alias("over_limit"), "fitting_chars", "steps_crc32")
