"""Token counts: pre-tokens that are proved to be one token are looked up, and only the others are merged by the tokenizer's library."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import table, trimmed

LIMIT = 4096
SPACE = "▁"
#: So many merged pre-tokens a worker remembers besides the proved ones, none of them longer than LONGEST characters.
KNOWN = 300_000
LONGEST = 64
#: Appended to a piece model's bytes this switches off the space it puts before a text (a field of a message may come twice, the last counts).
BARE = b"\x1a\x02\x18\x00"


@dataclass(frozen=True)
class Proof:
    """Of a vocabulary: whether texts may be cut where a space follows another character, and the pre-tokens that are one token each."""

    cuts: bool
    whole: frozenset[str]


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def proved(path: str) -> Proof:
    """Tries every string of the vocabulary once, as a pre-token by itself. A piece model's merges can't cross a place where no piece of it
    has the two characters side by side: so where no piece has a space behind another character, every such place parts a text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        suffix = getattr(t.model, "end_of_word_suffix", None) or ""
        words = {w.removesuffix(suffix) for w in t.get_vocab(with_added_tokens=False)}
        return Proof(True, frozenset(w for w in words if w and len(t.model.tokenize(w)) == 1))
    import sentencepiece

    with open(path, "rb") as f:
        bare = sentencepiece.SentencePieceProcessor(model_proto=f.read() + BARE)
    ids = [i for i in range(bare.get_piece_size()) if not (bare.is_control(i) or bare.is_byte(i) or bare.is_unknown(i))]
    pieces = [bare.id_to_piece(i) for i in ids]
    one = [p for i, p in zip(ids, pieces, strict=True) if bare.encode(p) == [i]]
    return Proof(not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces), frozenset(p[1:] for p in one if p[0] == SPACE))


class _Known(dict):
    """Numbers of tokens by pre-token; what isn't in it is merged, and remembered while there is room."""

    def __init__(self, whole: frozenset[str], merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.merge, self.room = merge, KNOWN

    def __missing__(self, word: str) -> int:
        n = self.merge(word)
        if self.room and len(word) <= LONGEST:
            self.room -= 1
            self[word] = n
        return n


class PieceCounter:
    """Of a piece model. A pre-token is a run of spaces and what stands up to the next one; its first space is left out of the key."""

    def __init__(self, path: str, proof: Proof):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cuts = proof.cuts
        self.known = _Known(proof.whole, lambda w: len(self.library.encode(w)))  # the library puts the first space there
        self.apart = re.compile(f"[ {SPACE}]+[^ {SPACE}]*").findall

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.library.encode(text))
        if text[0] == " " or "  " in text or SPACE in text:
            words = [w[1:] for w in self.apart(" " + text)]
        else:
            words = text.split(" ")
        return sum(map(self.known.__getitem__, words))


class WordCounter:
    """Of a .json file: its own normaliser and pre-tokenizer make the pre-tokens. Texts with strings of added tokens go to the library whole."""

    def __init__(self, path: str, proof: Proof):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = _Known(proof.whole, lambda w: len(self.library.model.tokenize(w)))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def count(self, text: str) -> int:
        if any(a.lower() in text.lower() for a in self.added):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return sum(self.known[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text))


_counters: dict[tuple[str, int], PieceCounter | WordCounter] = {}


def counter(path: str, proof: Proof) -> PieceCounter | WordCounter:
    key = path, hash(proof)
    if key not in _counters:
        _counters[key] = (WordCounter if path.endswith(".json") else PieceCounter)(path, proof)
    return _counters[key]


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, as the library of the public tokenizer `name` counts a whole text.

    Null texts are empty and have no tokens; texts of any length are counted whole; equal rows give equal rows, an empty table none;
    other columns play no part. Nothing is shuffled; workers get the proof, which is as large as the vocabulary.
    """
    sent = docs.sparkSession.sparkContext.broadcast(proved(model_path(name)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        count = counter(model_path(name), sent.value).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(trimmed(each), f"doc_id {kind}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
