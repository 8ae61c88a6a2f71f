"""Token counts (operator 3) and the worker-side encoder that packing shares.

A worker holds one encoder. Batches are balanced by bytes: whatever Arrow
delivers is cut into runs of about ``BATCH_BYTES`` of text, each run is encoded
by the library in batches, and long texts are cut at safe boundaries: at white
space where the vocabulary's steps are exactly those that drop it, before a space
between a non-space and a letter in plain byte-level ones, and else not at all.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20
MEMO_PARTS = 100_000
MEMO_WORDS = 200_000
MEMO_LONGEST = 48
#: A word that comes back stays as if it had been met so many batches later.
MEMO_AGAIN = 2


def _byte_letters() -> dict[int, str]:
    """The usual letter for each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others for the letters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class _Parts(dict):
    """Ids of parts of words, made by the library's model on first sight; of
    bounded size, and started anew when full."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def made(self, part: str) -> bytes:
        level = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(level)])

    def __missing__(self, part: str) -> bytes:
        ids = self.made(part)
        if len(part) <= MEMO_LONGEST:
            if len(self) >= MEMO_PARTS:
                self.clear()
            self[part] = ids
        return ids


class WordLengths:
    """Lengths for the one vocabulary kind ``WORDS`` describes, whose
    pre-tokenizer drops white space: a text's length is the sum of its words'.

    Nothing of that kind joins or changes anything across ASCII white space, so
    it is where texts are split. Arrow cuts a batch into words and finds the
    distinct ones; those not seen before go to the library in one batch."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.known: dict[str, int] = {}

    def lengths(self, texts: pa.Array) -> np.ndarray:
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = pc.dictionary_encode(words.flatten())
        distinct = flat.dictionary.to_pylist()
        if len(self.known) > MEMO_PARTS:
            self.known.clear()
        new = [w for w in distinct if w not in self.known]
        for at in range(0, len(new), 1 << 16):
            some = new[at : at + (1 << 16)]
            self.known.update(zip(some, map(len, self.library.encode_batch_fast(some, add_special_tokens=False))))
        size = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        total = np.append(0, np.cumsum(size[flat.indices.to_numpy()]))
        n_words = pc.list_value_length(words).to_numpy().astype(np.int64)
        ends = np.cumsum(n_words)
        return total[ends] - total[ends - n_words]


#: What is taken off a word of plain letters, and such a word: the vocabulary's pattern cuts there anyway.
ENDS = ("", ".", ",")
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


class WordIds:
    """Ids of texts for the same kind of vocabulary, for packing.

    A text's ids are the ids of its words in a row, and words repeat far more
    than texts. Arrow takes a stop or comma off a word of letters, lowers it and
    finds it in a table of words met before, whose ids stand in one array; when
    the table is full, the half that was met last stays, words that came
    back before new ones. A new word of ASCII and
    accented Latin-1 letters, digits and signs is cut into parts as the
    vocabulary's pattern does, and they go to the library's model; any other
    word goes through the whole library.
    """

    #: No apostrophe (the pattern's contractions), and no letter outside ASCII and Latin-1, where lower case and normal form are plain.
    plain = re.compile("[!-&(-~À-ÖØ-öø-ÿ]*")
    cut = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        self.library = _library(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        self.parts = _Parts(self.library.model)
        ends = [self._word(x) for x in ENDS]
        self.words, self.flat = pa.array(ENDS, pa.large_string()), np.frombuffer(b"".join(ends), "<u4")
        self.size, self.met, self.turn = np.array(list(map(len, ends))) // 4, np.full(len(ENDS), np.iinfo(np.int64).max), 0

    def _word(self, word: str) -> bytes:
        if self.plain.fullmatch(word) and not ("<" in word and self.special.search(word)):
            low = word.lower()
            return self.parts.made(low) if low.isalpha() else b"".join([self.parts[x] for x in self.cut.findall(low)])
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _forget(self) -> None:
        """Long words go, and of too many those that weren't met for longest."""
        if len(self.met) > MEMO_WORDS:
            self.met[np.argsort(self.met, kind="stable")[: -(MEMO_WORDS // 2)]] = -1
        keep = self.met >= 0
        if not keep.all():
            self.words, self.flat = self.words.filter(pa.array(keep)), self.flat[np.repeat(keep, self.size)]
            self.size, self.met = self.size[keep], self.met[keep]

    def _places(self, words: pa.Array) -> np.ndarray:
        """The place of each of these different words in the table, to which new ones are added."""
        self._forget()
        self.turn += 1
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(place))
        place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        seen = place >= 0
        place[~seen] = np.arange(len(self.met), len(self.met) + len(new))
        ids = list(map(self._word, new.to_pylist()))
        self.words = pa.concat_arrays([self.words, new])
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))
        self.size = np.append(self.size, np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        self.met = np.append(self.met, np.zeros(len(ids), np.int64))
        turn = np.where(pc.binary_length(words).to_numpy() <= MEMO_LONGEST, self.turn + MEMO_AGAIN * seen, -1)
        self.met[place] = np.where(place < len(ENDS), self.met[place], turn)
        return place

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as 32-bit integers, and where each text ends."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        each = pc.dictionary_encode(words.flatten())
        n_words = pc.list_value_length(words).to_numpy().astype(np.int64)
        distinct = each.dictionary
        letters = pc.match_substring_regex(distinct, LETTERS)
        stems = pc.dictionary_encode(pc.if_else(letters, pc.ascii_rtrim(pc.utf8_lower(distinct), ".,"), distinct))
        pair = np.zeros((len(distinct), 2), np.int64)
        pair[:, 0] = self._places(stems.dictionary)[stems.indices.to_numpy()]
        for place, sign in enumerate(ENDS):
            if sign:
                pair[pc.and_(letters, pc.ends_with(distinct, sign)).to_numpy(zero_copy_only=False), 1] = place
        place = pair[each.indices.to_numpy()].ravel()
        first, of_word = (np.cumsum(self.size) - self.size)[place], self.size[place]
        ends = np.cumsum(of_word)
        at = np.repeat(first - ends + of_word, of_word) + np.arange(of_word.sum())
        return self.flat[at], np.append(0, ends)[np.cumsum(2 * n_words)]


class Library:
    """Lengths and ids by the library itself, in batches of texts: for every other vocabulary.

    Only for plain byte-level vocabularies are long texts cut, where that is safe."""

    def __init__(self, path: str):
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.library = _library(path)
        self.cut = not self.pieces and _spec(path) == BYTES

    def _encoded(self, texts: pa.Array) -> Iterator[tuple[int, list[int]]]:
        """The ids of each part of each text, with the text's place."""
        parts = [(i, x) for i, t in enumerate(texts.to_pylist()) for x in (whole_text_pieces(t) if self.cut else [t])]
        if self.pieces:
            return zip([i for i, _ in parts], self.library.encode([x for _, x in parts], num_threads=1))
        encoded = self.library.encode_batch_fast([x for _, x in parts], add_special_tokens=False)
        return zip([i for i, _ in parts], (e.ids for e in encoded))

    def lengths(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, ids in self._encoded(texts):
            out[i] += len(ids)
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as 32-bit integers, and where each text ends."""
        size, flat = np.zeros(len(texts), np.int64), []
        for i, ids in self._encoded(texts):
            size[i] += len(ids)
            flat.append(np.array(ids, "<u4"))
        return np.concatenate(flat) if flat else np.array([], "<u4"), np.cumsum(size)


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def whole_text_pieces(text: str, limit: int = BATCH_BYTES) -> Iterator[str]:
    """Cut a long text before a single space that stands between a non-space
    and a letter. No pre-token of a byte-level vocabulary and no special
    string spans that place, so the ids of the parts are the ids of the whole."""
    safe = re.compile(r"(?<=\S) (?=[^\W\d_])")
    at = 0
    while len(text) - at > limit:
        m = safe.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


#: What a vocabulary file says of its steps before the model, where words can be taken one by one.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "plain": True,
}
#: The same of a plain byte-level vocabulary.
BYTES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "plain": True}


def _spec(path: str) -> dict:
    """The steps before the model. ``plain``: added strings hold no white space, are found as they are and
    eat none around them, and nothing comes after the model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens") or []
    plain = not spec.get("post_processor") and spec["model"].get("dropout") is None
    plain = plain and not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") or re.search(r"\s", t["content"]) for t in added)
    return {"normalizer": spec.get("normalizer"), "pre_tokenizer": spec.get("pre_tokenizer"), "plain": plain}


def takes_words(path: str) -> bool:
    """True if the vocabulary's steps are exactly those that ``WordLengths`` and ``WordIds`` know."""
    return path.endswith(".json") and _spec(path) == WORDS


_LOADED: dict[tuple, object] = {}


def encoder(path: str, need_ids: bool = False):
    """The worker's encoder; loaded once in each Python worker."""
    if (path, need_ids) not in _LOADED:
        _LOADED[path, need_ids] = (WordIds if need_ids else WordLengths)(path) if takes_words(path) else Library(path)
    return _LOADED[path, need_ids]


def by_bytes(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """The array in runs of about ``limit`` bytes."""
    size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, by the vocabulary file ``tokenizer`` (a
    path that every worker can read).

    Returns ``id_col, n_bytes, n_tokens, over_limit``, one row for each input
    row, in no shuffle. A null text counts as empty: 0 bytes, 0 tokens. Null
    ids and repeated rows stay as they are; an empty table gives an empty
    result; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = [int(x) for some in by_bytes(batch.column(1)) for x in enc.lengths(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
