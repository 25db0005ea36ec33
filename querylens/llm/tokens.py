"""Token ids of whole texts, by a tokenizer file of the ``tokenizers`` library.

Tokenizers that drop white space see each run of other characters on its own,
so runs are split and numbered by Arrow and only new ones are encoded; the
rest is gathering in numpy.  Other tokenizers get the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers from one group of texts to the next: those it
#: met first, which the frequent ones are among.
KEPT = 100_000
#: Bytes of text that are encoded at once, unless one is longer: the more, the
#: fewer runs come twice, but the numbers of all runs are in memory.
GROUP = 4 << 20
#: Runs that are held as Python strings at once.
RUNS = 40_000
#: Ids that are put together at once; bounds memory whatever the texts.
SLICE = 1 << 19
#: Runs encoded in one call.
TOGETHER = 4096
#: The words pattern of the tokenizers that are split by run.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs of ASCII and Latin-1 letters: nothing in them composes, has a special
#: lower case or depends on a Unicode version.  None can hold a special token.
SIMPLE = re.compile("[\x00-;=-~À-ÖØ-öø-ÿ]*")
#: The same pattern on such runs, in lower case (they hold no white space), and
#: the line's end that is put between them.
SIMPLE_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest
    for the characters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` at some starts, one after the other."""
    ends = np.cumsum(sizes)
    where = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    where += np.arange(len(where), dtype=np.int32)
    return ids[where]


class RaggedTokenizer:
    """Encodes Arrow batches of texts to one flat id array and row lengths."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            data = f.read()
        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        spec = json.loads(data)
        self.by_run = self._drops_white_space(spec)
        plain = [t for t in spec.get("added_tokens") or [] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.separator = (plain[0]["content"], plain[0]["id"]) if plain else None
        self.alphabet = _byte_characters()
        self._forget()

    @staticmethod
    def _drops_white_space(spec: dict) -> bool:
        """Whether the first pre-tokenizer keeps only matches of a pattern
        none of whose parts can hold white space, and nothing normalises
        across it."""
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        local = {"NFC", "Lowercase"}
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        return (
            first.get("type") == "Split"
            and first.get("invert")
            and first.get("behavior") == "Removed"
            and pattern == WORDS
            and all(s["type"] in local or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
        )

    def _forget(self) -> None:
        self.hard: dict[str, np.ndarray] = {}
        # words of simple runs: number 0 is the line's end between runs
        self.words: dict[str, int] = {"\n": 0}
        self.word_starts = np.zeros(1, dtype=np.int64)
        self.word_sizes = np.zeros(1, dtype=np.int64)
        self.word_ids = np.zeros(0, dtype=np.uint32)

    def _forget_late(self) -> None:
        """Keep the first words only."""
        if len(self.hard) > KEPT // 4:
            self.hard = dict(islice(self.hard.items(), KEPT // 8))
        if len(self.words) > KEPT:
            self.words = dict(islice(self.words.items(), KEPT))
            self.word_starts, self.word_sizes = self.word_starts[:KEPT].copy(), self.word_sizes[:KEPT].copy()
            self.word_ids = self.word_ids[: int(self.word_starts[-1] + self.word_sizes[-1])].copy()

    def _learn(self, words: list[str]) -> None:
        """Number words that are new, with their ids by the model."""
        tokenize, alphabet, found, sizes = self.tokenizer.model.tokenize, self.alphabet, [], []
        for word in words:
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(alphabet)
            own = [t.id for t in tokenize(letters)]
            found += own
            sizes.append(len(own))
        first = len(self.word_starts)
        self.words.update(zip(words, range(first, first + len(words))))
        sizes = np.array(sizes, dtype=np.int64)
        self.word_starts = np.concatenate([self.word_starts, len(self.word_ids) + np.cumsum(sizes) - sizes])
        self.word_sizes = np.concatenate([self.word_sizes, sizes])
        self.word_ids = np.concatenate([self.word_ids, np.array(found, dtype=np.uint32)])

    def _encode_simple(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs, ids of each run) of simple runs, the ids that the
        library would give: all runs are cut into words at once."""
        words = SIMPLE_WORDS.findall("\n".join(runs).lower())
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = self.word_sizes[number]
        return gathered(self.word_ids, self.word_starts[number], sizes), np.bincount(np.cumsum(number == 0), weights=sizes, minlength=len(runs)).astype(np.int64)

    def _encode_hard(self, runs: list[str]) -> list:
        plain = self.tokenizer.encode
        if not self.separator:
            return [np.array(plain(r, add_special_tokens=False).ids, dtype=np.uint32) for r in runs]
        text, number = self.separator
        alone = [text[0] in r for r in runs]  # may hold or touch a special token
        out: list = [None] * len(runs)
        for i in np.nonzero(alone)[0]:
            out[i] = np.array(plain(runs[i], add_special_tokens=False).ids, dtype=np.uint32)
        rest = np.nonzero(~np.array(alone, dtype=bool))[0]
        for at in range(0, len(rest), TOGETHER):
            part = rest[at : at + TOGETHER]
            ids = np.array(plain(text.join([runs[i] for i in part]), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.append(np.nonzero(ids == number)[0], len(ids))
            start = 0
            for i, end in zip(part, ends, strict=True):
                out[i] = ids[start:end]
                start = end + 1
        return out

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each run start, how many it has)."""
        simple = np.array([("<" not in r) if r.isascii() else SIMPLE.fullmatch(r) is not None for r in runs], dtype=bool)
        easy = np.nonzero(simple)[0].tolist()
        ids, own = self._encode_simple([runs[i] for i in easy] if len(easy) < len(runs) else runs) if easy else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        sizes = np.zeros(len(runs), dtype=np.int64)
        sizes[easy] = own
        starts = np.zeros(len(runs), dtype=np.int64)
        starts[easy] = np.cumsum(own) - own
        rest = np.nonzero(~simple)[0].tolist()
        if rest:
            new = [runs[i] for i in rest if runs[i] not in self.hard]
            self.hard.update(zip(new, self._encode_hard(new)))
            found = [self.hard[runs[i]] for i in rest]
            sizes[rest] = own = np.array([len(x) for x in found], dtype=np.int64)
            starts[rest] = len(ids) + np.cumsum(own) - own
            ids = np.concatenate([ids, *found])
        return ids, starts, sizes

    def _encode_dictionary(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`_encode_runs`, of some runs at a time."""
        self._forget_late()
        parts, before = [], 0
        for at in range(0, len(runs), RUNS):
            ids, starts, sizes = self._encode_runs(runs.slice(at, RUNS).to_pylist())
            parts.append((ids, starts + before, sizes))
            before += len(ids)
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.uint32), *[np.zeros(0, dtype=np.int64)] * 2)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text); a null text has none."""
        parts = list(self.encode_slices(texts))
        none = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(none, *parts))

    def encode_slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What :meth:`encode` returns, in slices of whole texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_run:
            for text in texts:
                found = np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, dtype=np.uint32)
                yield found, np.array([len(found)], dtype=np.int64)
            return
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        runs = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        del split
        number = runs.indices.to_numpy(zero_copy_only=False)
        ids, starts, sizes = self._encode_dictionary(runs.dictionary)
        edges = np.concatenate([[0], np.cumsum(sizes[number])])[bounds]
        row = 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(edges, edges[row] + SLICE, side="right")) - 1)
            own = number[bounds[row] : bounds[last]]
            yield gathered(ids, starts[own], sizes[own]), np.diff(edges[row : last + 1])
            row = last


def _cut(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(rows of a batch, bytes of their text and of a few numbers a row), at most
    ``size`` unless one text is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 16, dtype=np.int64)
    row = before = 0
    while row < len(ends):
        last = max(row + 1, int(np.searchsorted(ends, before + size, side="right")))
        # copied, as in common.slices
        part = batch if last - row == len(ends) else batch.take(pa.array(range(row, last), pa.int64()))
        yield part, int(ends[last - 1]) - before
        row, before = last, int(ends[last - 1])


def grouped(batches: Iterable[pa.RecordBatch], column: int, size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined to ``size`` bytes of text each at most; a longer
    text is one of its own."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        for part, n in _cut(batch, column, size):
            if held and total + n > size:
                yield pa.concat_batches(held)
                held, total = [], 0
            held.append(part)
            total += n
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> RaggedTokenizer:
    """The worker's tokenizer for a file."""
    return RaggedTokenizer(path)
