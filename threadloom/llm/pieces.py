"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import prepare

#: Marker of a space before a word.
SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Threads of a worker. Cores are shared by an executor's tasks, so a few do.
THREADS = 2
#: Encoded words that a worker keeps; new words that are encoded as one text.
KEPT_WORDS, WORDS_AT_ONCE = 200_000, 500


class Words(dict):
    """Numbers words in the order in which they are first looked up."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Codec:
    """A SentencePiece model rebuilt from its file, next to the reference library that it is held against.

    The normaliser, the marker of spaces, scores (unigram) or merges in the order of scores (BPE) and byte fallback
    come from the model's protobuf. Texts are cut before each run of markers where no piece spans such a cut, so
    words are encoded once, many at a time on THREADS threads. The ids are the rebuilt model's; each distinct word is
    also encoded by the reference, and those on which the two differ are counted.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            content = f.read()
        self.proto = sentencepiece_model_pb2.ModelProto.FromString(content)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=content)
        spec = self.proto.normalizer_spec
        # The cut by words needs a normaliser that keeps the text, and pieces that don't go on behind a space.
        self.by_word = (
            not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in self.proto.pieces if p.type in (NORMAL, USER))
            and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or self.proto.trainer_spec.treat_whitespace_as_suffix)
            and spec.escape_whitespaces
            and spec.add_dummy_prefix
        )
        self.tokenizer = rebuilt(self.proto)
        self.starts = np.array([p.piece.startswith(SPACE) for p in self.proto.pieces])
        self._forget()

    def _forget(self) -> None:
        self.words = Words()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.odd, self.changed = np.zeros(0, bool), np.zeros(0, bool)

    def _cut(self, text: str) -> list[str]:
        """Words of a text: as they are between single spaces, else with the markers before them."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return WORDS.findall(SPACE + text.replace(" ", SPACE))
        return text.split(" ")

    def _learn(self, new: list[str]) -> None:
        """Encodes words by both libraries, many as one text where that gives each word's ids, else one by one."""
        ids, sizes, odd, changed = [self.ids], [], [], []
        groups = [new[at : at + WORDS_AT_ONCE] for at in range(0, len(new), WORDS_AT_ONCE)]
        texts = [" ".join(g) for g in groups]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([SPACE + t.replace(" ", SPACE) for t in texts], add_special_tokens=False)]
        theirs, back = self.reference.encode(texts, num_threads=THREADS), self.decode(coded)
        for words, text, one, other, again in zip(groups, texts, coded, theirs, back, strict=True):
            got = np.array(one, np.int32)
            first = np.nonzero(self.starts[got])[0]
            if len(first) == len(words) and one == other and again == text and not any(w.startswith(SPACE) for w in words):
                ids.append(got)
                sizes.append(np.diff(np.append(first, len(got))))
                odd.append(np.zeros(len(words), bool))
                changed.append(np.zeros(len(words), bool))
                continue
            marked = [w if w.startswith(SPACE) else SPACE + w for w in words]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
            right = self.reference.encode([w[1:] for w in marked], num_threads=THREADS)
            # A single marker, at a text's end, is no text of its own to the reference: there it is this one piece.
            right = [x if w != SPACE else [self.reference.piece_to_id(SPACE)] for w, x in zip(marked, right, strict=True)]
            ids += [np.array(x, np.int32) for x in ours]
            sizes.append(np.array([len(x) for x in ours], np.int64))
            odd.append(np.array([x != y for x, y in zip(ours, right, strict=True)], bool))
            changed.append(np.array([x != y[1:].replace(SPACE, " ") for x, y in zip(self.decode(ours), marked, strict=True)], bool))
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        self.odd, self.changed = np.concatenate([self.odd, *odd]), np.concatenate([self.changed, *changed])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's end, how many of its words are encoded differently, whether it decodes."""
        if not self.by_word:
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.reference.encode(texts, num_threads=THREADS)
            back = self.decode(ours)
            ends = np.cumsum([len(x) for x in ours], dtype=np.int64)
            return np.array([i for x in ours for i in x], np.int32), ends, np.array([x != y for x, y in zip(ours, theirs, strict=True)], np.int64), np.array([x == y for x, y in zip(texts, back, strict=True)], bool)
        if len(self.words) > KEPT_WORDS:
            self._forget()
        look = self.words.__getitem__
        numbers = [np.fromiter(map(look, w), np.int64, len(w)) for w in map(self._cut, texts)]
        if self.words.new:
            self._learn(self.words.new)
            self.words.new.clear()
        word = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        last = np.cumsum([len(x) for x in numbers], dtype=np.int64)
        start, size = self.ends[word], self.ends[word + 1] - self.ends[word]
        total = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        odd, changed = (np.append(0, np.cumsum(x[word]))[np.append(0, last)] for x in (self.odd, self.changed))
        # A marker in a text comes back as a space.
        back = (np.diff(changed) == 0) & np.array([SPACE not in t for t in texts], bool)
        return ids, total[last], np.diff(odd), back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def rebuilt(proto) -> Tokenizer:
    """The model in the tokenizers library. Its input has markers for spaces and the prefix where texts are cut by words."""
    pieces, spec = proto.pieces, proto.normalizer_spec
    unknown = next((i for i, p in enumerate(pieces) if p.type == UNKNOWN), 0)
    fallback = bool(proto.trainer_spec.byte_fallback)
    if proto.trainer_spec.model_type == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p.piece, p.score) for p in pieces], unknown, fallback))
    elif proto.trainer_spec.model_type == BPE:
        vocabulary = {p.piece: i for i, p in enumerate(pieces)}
        merges = []
        for i, p in enumerate(pieces):
            if p.type == NORMAL:
                halves = ((p.piece[:k], p.piece[k:]) for k in range(1, len(p.piece)))
                merges += [(-p.score, i, vocabulary[a], vocabulary[b], (a, b)) for a, b in halves if a in vocabulary and b in vocabulary]
        merges.sort()
        tokenizer = Tokenizer(models.BPE(vocabulary, [m[-1] for m in merges], unk_token=pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback))
    else:
        raise ValueError(f"model type {proto.trainer_spec.model_type} has no scores to rebuild")
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    plain = not steps and spec.escape_whitespaces
    if not plain:
        steps += [normalizers.Prepend(SPACE)] * bool(spec.add_dummy_prefix) + [normalizers.Replace(" ", SPACE)] * bool(spec.escape_whitespaces)
        tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORDS.pattern), "isolated") if plain else None
    parts = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * bool(spec.add_dummy_prefix))
    return tokenizer


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    return Codec(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, n_tokens, n_odd, round_trip) of every row of `docs` (doc_id, text).

    ids: those of the model rebuilt from the file `model`, which lies at that path on every executor; whole
    texts are encoded. n_odd: the text's words on which the rebuilt model and the reference library differ.
    round_trip: the ids decode to the text. A null text has null ids and tokens and a null round_trip, an empty one
    none and a true one. Repeated rows stay, an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for b in batches:
            texts = b.column(1)
            ids, ends, odd, back = use.encode(texts.fill_null("").to_pylist())
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            sizes = np.diff(ends, prepend=0)
            columns = [
                b.column(0),
                pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids), mask=pa.array(missing)),
                pa.array(sizes, pa.int64(), mask=missing),
                pa.array(odd, pa.int64(), mask=missing),
                pa.array(back, pa.bool_(), mask=missing),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "n_odd", "round_trip"])
        use._forget()  # a worker may wait for other tasks for long

    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, n_odd bigint, round_trip boolean")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of every row of `coded` (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for b in batches:
            ids = b.column(1).to_pylist()
            texts = use.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], ["doc_id", "text"])

    prepare(coded.sparkSession)
    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, f"doc_id {kind}, text string")
