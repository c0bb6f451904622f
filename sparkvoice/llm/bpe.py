"""BPE encoding with forced boundaries, and decoding, for tokenizer files of the public ``tokenizers`` library.

A pair of neighbouring bytes that no token of the vocabulary holds inside can never be merged over, so a word is
certainly cut there. The fragments between such cuts are encoded independently, each merge being the one of lowest
rank, leftmost first, and their ids are put one after another. The fragment that ends a word carries the word end.

Defined cases: null and empty texts have no tokens (the digests are those of the empty text); white space is dropped,
as the vocabulary asks; special tokens written in a text become their ids; repeated rows are encoded one by one; an
empty table gives an empty table; other columns are ignored by ``digests`` and kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Words that a worker remembers before it starts afresh, and characters of text that it takes at a time.
CACHE = 400_000
CHUNK = 2_000_000
NONE = 1 << 30


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """One tokenizer file, with a store of words of bounded size."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        model = file["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.tokens}
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        #: Ids of a byte within and at the end of a word.
        self.within = np.array([vocab[c] for c in letters])
        self.ending = np.array([vocab[c + suffix] for c in letters])
        #: Whether a token holds the two bytes side by side; where not, a cut is certain.
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            for body in {token, token.removesuffix(suffix) if suffix else token}:
                held = [byte_of[c] for c in body if c in byte_of]
                self.joined[held[:-1], held[1:]] = True
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges]) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges])
        born = np.full(max(vocab.values()) + 1, -1)
        born[made] = np.arange(len(merges))
        if (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a token that only a later merge makes")
        key = left << 32 | right
        self.order = np.argsort(key)
        self.keys, self.made = key[self.order], made
        pattern = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.words: dict[str, tuple[str, str]] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            # Letter by letter: a sigma at a word's end is no exception here.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. All fragments of all words are merged side by side."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        out: list[list[int]] = [[] for _ in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if not len(data):
            return out
        ends = np.cumsum(sizes[sizes > 0])
        symbol = self.within[data]
        symbol[ends - 1] = self.ending[data[ends - 1]]
        first = np.zeros(len(data), dtype=bool)
        first[0] = True
        first[ends[:-1]] = True
        first[1:] |= ~self.joined[data[:-1], data[1:]]
        fragment = np.cumsum(first) - 1
        word_of = np.repeat(np.arange(len(words)), sizes)[first]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), NONE)
        inner = np.flatnonzero(fragment[:-1] == fragment[1:])
        rank[inner] = self._rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            spread = np.repeat(low, np.diff(np.append(starts, len(symbol))))
            over = spread == NONE
            if over.any():
                done.append((fragment[over], symbol[over]))
                symbol, fragment, rank, spread = symbol[~over], fragment[~over], rank[~over], spread[~over]
                if not len(symbol):
                    break
            # All places of the fragment's lowest merge; of places side by side every other one, from the left.
            hit = np.flatnonzero(rank == spread)
            run = np.concatenate([[0], np.cumsum(np.diff(hit) != 1)])
            head = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            hit = hit[(np.arange(len(hit)) - head[run]) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            place = (np.cumsum(stay) - 1)[hit]
            symbol, fragment, rank = symbol[stay], fragment[stay], rank[stay]
            for at in (place, place[place > 0] - 1):
                rank[at] = NONE
                at = at[at + 1 < len(symbol)]
                at = at[fragment[at] == fragment[at + 1]]
                rank[at] = self._rank(symbol[at], symbol[at + 1])
        part = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])[np.argsort(part, kind="stable")]
        counts = np.bincount(word_of[part], minlength=len(words))
        at, flat = 0, ids.tolist()
        for i, n in enumerate(counts.tolist()):
            out[i] = flat[at : at + n]
            at += n
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            plain = text[at : m.start()] if m else text[at:]
            for ids in self.encode_words(self.find(self.normal(plain))):
                out += ids
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def decode(self, ids) -> str:
        """The file names no decoder, so tokens are joined by a space; unknown ids give nothing."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])

    def _learn(self, chunks: list[str]) -> None:
        """Keep the ids and the decoded text of stretches without white space, each as one string."""
        split = [[c] if c.isascii() and c.isalpha() else self.find(c) for c in chunks]
        new = list({w for ws in split for w in ws})
        known = dict(zip(new, self.encode_words(new), strict=True))
        numbers = self.numbers
        for c, ws in zip(chunks, split, strict=True):
            ids = [i for w in ws for i in known[w]]
            self.words[c] = (" ".join([numbers[i] for i in ids]), self.decode(ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens and the digests of the ids and of the decoded text."""
        out: list[tuple[int, str, str]] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK):
                size += len(texts[stop])
                stop += 1
            chunks = [self._chunks(t) for t in texts[start:stop]]
            need = set().union(*[c for c in chunks if isinstance(c, list)])
            missing = [w for w in need if w not in self.words]
            if len(self.words) + len(missing) > CACHE:
                self.words.clear()
                missing = list(need)
            self._learn(missing)
            words = self.words
            for c in chunks:
                if isinstance(c, list):
                    got = [words[w] for w in c]
                    ids, decoded = " ".join([g[0] for g in got if g[0]]), " ".join([g[1] for g in got if g[0]])
                else:
                    listed = self.encode(c)
                    ids, decoded = " ".join(map(str, listed)), self.decode(listed)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (ids, decoded)]
                out.append((ids.count(" ") + 1 if ids else 0, *sha))
            start = stop
        return out

    def _chunks(self, text: str) -> list[str] | str:
        """The stretches between white space, or the text itself if it holds a special token or separators that
        Python splits at though they are no white space."""
        if self.cut and self.cut.search(text) or ODD.search(text):
            return text
        return self.normal(text).split()


ODD = regex.compile("[\x1c-\x1f]")
_codecs: dict[int, Codec] = {}


def _codec(spec: str) -> Codec:
    """One codec for each file and worker."""
    key = hash(spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    # A vocabulary file has a fixed size, a few MB, whatever the corpus.
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches):
        codec = _codec(spec.value)
        for batch in batches:
            rows = codec.digests([t or "" for t in batch.column(1).to_pylist()])
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.words.clear()

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of every text in a further column."""
    spec = spark.sparkContext.broadcast(read_spec(path))

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        codec = _codec(spec.value)
        return texts.map(lambda t: codec.encode(t or ""))

    return docs.withColumn(ids, ids_of(F.col(f"`{text}`")))


def decode(spark: SparkSession, docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of the token ids in a further column; null ids give the empty text."""
    spec = spark.sparkContext.broadcast(read_spec(path))

    @F.pandas_udf("string")
    def text_of(lists):
        codec = _codec(spec.value)
        return lists.map(lambda i: codec.decode([int(x) for x in i]) if i is not None else "")

    return docs.withColumn(text, text_of(F.col(f"`{ids}`")))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: digests of every document's tokens."""
    return digests(spark, table(spark, sf_dir, "documents"), tokenizer_path())
