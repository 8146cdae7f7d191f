"""BPE with word ends by batched numpy merge rounds, and its decoding.

1. ``split``: special tokens are cut out of the raw text; what stands between them is normalised (composed, white space to one
   blank, lower case) and cut into words.
2. ``Merges.encode``: the symbols of many words lie in one flat array, each a byte, the last of a word a byte with the word's end.
   In each round the rank of every pair of neighbours in a word is found by binary search over the sorted keys of all pairs;
   each word's pair of the lowest rank merges wherever it stands, from left to right, and words without a pair leave.
3. ``encode``: a task keeps the ids of the distinct words it has met, at most ``WORDS_HELD``, and encodes the new ones of each
   batch of texts together; a text's ids are gathered by the positions of its words. Tasks share nothing, so nothing is
   shuffled or broadcast but the vocabulary, and a lost task is simply run again.
4. ``decode`` joins the table of the tokens' texts, which is as large as the vocabulary, and puts a blank between tokens, as the
   library does where a vocabulary names no decoder.

A round may merge all places of a pair at once if no pair that holds a merge's result has a lower rank than that merge; this is
checked when the vocabulary is read, and where it fails only the first place of each word merges in a round.

Null texts count as empty and give no ids. Ids of rows may repeat or be null; every row is encoded. Words have no length limit.
An empty table gives an empty result. Other columns aren't read, whatever their names. Ids outside the vocabulary can't be
decoded: an error.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.byte_bpe import gathered
from tallyspark.llm.common import shipped, sliced, table

VOCABULARY_FILE = "word_bpe_49k.json"
#: Distinct words whose ids a task keeps.
WORDS_HELD = 400_000
END = "</w>"
#: The vocabulary's pattern, without its special tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def read_vocabulary(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY_FILE), "rb") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next beyond the first 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    own = set(printable)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The pairs of a vocabulary as sorted keys, with rank and result of each."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], "i8")
        self.last = np.array([vocab[c + end] for c in letters], "i8")
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], "i8").reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        keys, first = np.unique(keys, return_index=True)  # the first of a repeated pair counts
        self.keys, self.rank, self.result = keys, first, pairs[first, 2]
        self.none = len(pairs)
        # Every place at once only if what a merge makes comes later as a part than as a result.
        size = max(vocab.values()) + 1
        earliest, latest = np.full(size, self.none), np.full(size, -1)
        for part in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(earliest, part, self.rank)
        np.maximum.at(latest, self.result, self.rank)
        self.all_at_once = bool((latest < earliest).all())

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, none of them empty, one after the other, and where each begins; and the end."""
        lengths = np.fromiter(map(len, words), "i8", len(words))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        raw = np.frombuffer(b"".join(words), "u1")
        flat = self.inner[raw]
        if len(words):
            flat[starts[1:] - 1] = self.last[raw[starts[1:] - 1]]
        who = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            rank, result = self._pairs(flat, starts)
            best = np.minimum.reduceat(rank, starts[:-1])
            open_ = best < self.none
            if not open_.all():
                keep = np.repeat(open_, np.diff(starts))
                done.append((who[~open_], np.diff(starts)[~open_], flat[~keep]))
                flat, rank, result = flat[keep], rank[keep], result[keep]
                starts = np.concatenate(([0], np.cumsum(np.diff(starts)[open_])))
                who, best = who[open_], best[open_]
                if not len(who):
                    break
            hit = rank == np.repeat(best, np.diff(starts))
            at = self._places(hit, starts)
            flat[at] = result[at]
            left = np.ones(len(flat), bool)
            left[at + 1] = False
            starts = np.concatenate(([0], np.cumsum(np.add.reduceat(left, starts[:-1], dtype="i8"))))
            flat = flat[left]
        if not done:
            return np.zeros(0, "i8"), np.zeros(1, "i8")
        # Words left in another order than they came.
        order = np.concatenate([w for w, _, _ in done])
        sizes, ids = np.concatenate([n for _, n, _ in done]), np.concatenate([x for _, _, x in done])
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        place = np.argsort(order)
        sizes, begins = sizes[place], begins[place]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _pairs(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each symbol with its next; no rank at a word's end."""
        rank = np.full(len(flat), self.none)
        result = np.zeros(len(flat), "i8")
        if len(flat) > 1:
            keys = flat[:-1] << 32 | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            rank[:-1][found], result[:-1][found] = self.rank[at[found]], self.result[at[found]]
            rank[starts[1:] - 1] = self.none
        return rank, result

    def _places(self, hit: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where to merge: every hit, but of neighbours, as in a run of one letter, every other one from the left."""
        at = np.flatnonzero(hit)
        if not self.all_at_once:
            word = np.searchsorted(starts, at, "right")
            return at[np.concatenate(([True], np.diff(word) != 0))]
        fresh = np.concatenate(([True], np.diff(at) > 1))
        begun = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        return at[(at - begun) % 2 == 0]


class Vocabulary:
    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw = raw.decode()
        shown = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.shown = pa.array([f"{shown[i]} ".encode() if i in shown else None for i in range(max(shown) + 1)], pa.large_binary())
        self._splitters()

    def _splitters(self) -> None:
        import regex

        # Classes of characters within the basic plane, which expressions look up in one step.
        number, unknown = [], []
        for c in map(chr, range(0x10000)):
            kind = unicodedata.category(c)
            if kind in ("Nl", "No"):
                number.append(c)
            elif kind == "Cn":
                unknown.append(c)
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda text: [text]
        # Characters younger than Python's tables go by the library's own.
        self._unknown = re.compile(f"[{''.join(unknown)}]").search
        self._beyond = re.compile("[\U00010000-\U0010ffff]").findall
        # The fast pattern's classes are the vocabulary's but for numbers that aren't decimal digits and four control characters.
        self._odd = re.compile(f"[\x1c-\x1f{''.join(number)}]").search
        self._usual = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
        self._exact = regex.compile(PATTERN).findall
        self._blank = regex.compile(r"\s+").sub
        self._library = None

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif self._unknown(text) or any(unicodedata.category(c) in ("Cn", "Nl", "No") for c in set(self._beyond(text))):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self.raw)
            text = self._library.normalizer.normalize_str(text)
            plain = bytes.fromhex
            letters = {c: f"{b:02x}" for b, c in enumerate(byte_letters())}
            return [plain("".join(map(letters.get, w))).decode() for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]
        else:
            text = self._blank(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return (self._exact if self._odd(text) else self._usual)(text)

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand among them as they are, with a NUL before them."""
        if "<|" not in text:
            return self._words(text)
        out = []
        for k, part in enumerate(self._cut(text)):
            if k % 2:
                out.append("\0" + part)
            else:
                out.extend(self._words(part))
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each, unsigned 32-bit and little-endian."""
        ids, ends = self.merges.encode([w.encode() for w in words])
        data, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
        return [data[a:b] if w[0] != "\0" or w[1:] not in self.special else np.uint32(self.special[w[1:]]).astype("<u4").tobytes() for w, a, b in zip(words, ends, ends[1:])]


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", raw: bytes | None = None, held: int = WORDS_HELD) -> DataFrame:
    """``doc_id, ids``: the ids of each text, unsigned 32-bit, little-endian, one after the other."""
    kind = df.schema[doc_id].dataType.simpleString()
    shared = shipped(df.sparkSession).sparkContext.broadcast(raw or read_vocabulary())  # as large as the vocabulary

    def run(batches):
        v = vocabulary(shared.value)
        place: dict[str, int] = {}
        ids: list[bytes] = []
        for batch in sliced(batches):
            if len(place) > held:
                place, ids = {}, []
            lengths, positions, fresh = [], [], []
            for value in batch.column(1):
                found = v.split(value.as_py() or "")
                for w in set(found).difference(place):
                    place[w] = len(place)
                    fresh.append(w)
                lengths.append(len(found))
                positions.append(np.fromiter(map(place.__getitem__, found), "i8", len(found)))
            ids += v.encode(fresh)
            out = gathered(pa.array(ids, pa.binary()), np.concatenate(positions) if positions else np.zeros(0, "i8"), lengths)
            yield pa.record_batch({doc_id: batch.column(0), "ids": out.cast(pa.binary())})

    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids binary")


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", raw: bytes | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the tokens' texts with a blank between them, in UTF-8."""
    shared = shipped(df.sparkSession).sparkContext.broadcast(raw or read_vocabulary())
    kind = df.schema[doc_id].dataType.simpleString()

    def join(batches):
        shown = vocabulary(shared.value).shown
        for batch in sliced(batches):
            each = [np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column(1)]
            found = gathered(shown, np.concatenate(each), list(map(len, each)))
            decoded = pa.array([x.as_py()[:-1] for x in found], pa.binary())
            yield pa.record_batch({doc_id: batch.column(0), "ids": batch.column(1), "decoded": decoded})

    return df.select(doc_id, F.col(ids).alias("ids")).mapInArrow(join, f"`{doc_id}` {kind}, ids binary, decoded binary")


def op11_word_bpe(spark, sf_dir):
    found = decode(encode(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
