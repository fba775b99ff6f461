"""Encoding a corpus with a public byte-level BPE, each distinct piece of text once.

Spark cuts texts before their spaces, and only those that BY_PATTERN matches (or that hold MARK) into words by the tokenizer's own
pattern, which the tokenizer applies again within each piece. So 'word' and 'word,' are pieces of their own, and a text without spaces that
BY_PATTERN doesn't match, such as values between tabs, is one piece. The pieces are called words below. A chunk of documents keeps its words as positions in the
chunk's list of distinct words; those lists are small beside the texts where pieces repeat, and only they are shuffled to find the corpus'
distinct words, encode each once, and bring the ids back. A word that stands everywhere costs one row for each chunk.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import partial
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.session import Saved, small_side

#: Default folder of the tokenizer files, described in its README.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the tokenizer's word pattern.
TIKTOKEN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: White space as the tokenizer sees it, written out as Java's \s is ASCII only.
SPACE = r"\t-\r \u0085\p{Z}"
#: The word pattern for Java, whose $ also matches before a last line end.
PATTERN = TIKTOKEN_PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace("$", r"\z")

# Before a space that isn't inside white space a word always ends, so a text may as well be cut before its spaces, which is much
# faster. Not so where a space stands between white space, and not in scripts written without spaces: there pieces would seldom repeat.
BY_PATTERN = rf"[{SPACE}] [{SPACE}]|[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF]"

#: Stands between words on their way to the workers, as one long text moves faster than many short ones. A text that holds it goes word by word.
MARK = "\0"

#: Words of one chunk; a chunk is what one task decodes at a time. A single longer text is a chunk of its own.
CHUNK_WORDS = 1_000_000


def ranks(folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Piece to id of the vocabulary file."""
    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(folder: str = TOKENIZERS):
    """The tokenizer, loaded once a Python process: this module's globals travel with each task, so it is kept in one that stays."""
    import tiktoken

    kept = sys.modules.setdefault("chainloom_loaded_tokenizers", ModuleType("chainloom_loaded_tokenizers")).__dict__
    if folder not in kept:
        kept[folder] = tiktoken.Encoding("bytes", pat_str=TIKTOKEN_PATTERN, mergeable_ranks=ranks(folder), special_tokens={})
    return kept[folder]


def _cuts(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of CHUNK_WORDS words at most, or of one document."""
    start, words = 0, 0
    for i, n in enumerate(lens.tolist()):
        if i > start and words + n > CHUNK_WORDS:
            yield start, i
            start, words = i, 0
        words += n
    if start < len(lens):
        yield start, len(lens)


def _split(marked: pa.Array, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, their numbers by text). Empty words may be among them; they have no ids."""
    lists = pc.split_pattern(marked, MARK)
    if words.null_count < len(words):  # some texts hold the mark themselves
        lists = pa.array([m if w is None else w for m, w in zip(lists.to_pylist(), words.to_pylist())], pa.list_(pa.string()))
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _text_words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    return _split(batch.column(1), batch.column(2))


def _listed_ids(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(ids of all lists, their numbers by list); a null list is an empty one."""
    lists = batch.column(1)
    lists = pc.if_else(pc.is_valid(lists), lists, pa.scalar([], lists.type))
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(batches, parts=_text_words):
    """Rows of documents and words (or ids) as chunks: one row with the coded documents, one for each distinct word."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    names = ["chunk", "i", "word", "docs", "lens", "codes"]
    for batch in batches:
        ids = batch.column(0)
        flat, lens = parts(batch)
        at = np.append(0, np.cumsum(lens))
        for a, b in _cuts(lens):
            coded = flat.slice(at[a], at[b] - at[a]).dictionary_encode()
            n, found = b - a, len(coded.dictionary)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint16 if found <= 65536 else np.uint32)
            row = [
                pa.array([number], pa.int64()),
                pa.array([-1], pa.int32()),
                pa.nulls(1, flat.type),
                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.slice(a, n)),
                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(lens[a:b].astype(np.int32))),
                pa.array([codes.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(row, names=names)
            empty = pa.nulls(found, pa.list_(ids.type)), pa.nulls(found, pa.list_(pa.int32())), pa.nulls(found, pa.binary())
            row = [pa.array(np.full(found, number)), pa.array(np.arange(found, dtype=np.int32)), coded.dictionary, *empty]
            yield pa.RecordBatch.from_arrays(row, names=names)
            number += 1


def _gather(left: pa.Table, right: pa.Table, values: str = "ids") -> tuple[pa.Array, pa.Array, np.ndarray, pa.Array]:
    """Of one chunk: its documents, their numbers of words, the words by position, and the `values` by code."""
    docs = left.column("docs").combine_chunks().flatten()
    lens = left.column("lens").combine_chunks().flatten()
    raw = left.column("codes")[0].as_py()
    found = right.num_rows
    codes = np.frombuffer(raw, np.uint16 if found <= 65536 else np.uint32)
    order = np.argsort(right.column("i").to_numpy())
    return docs, lens, codes, right.column(values).combine_chunks().take(pa.array(order))


def _ids(left: pa.Table, right: pa.Table) -> pa.Table:
    docs, lens, codes, ids = _gather(left, right)
    taken = ids.take(pa.array(codes))
    ends = np.append(0, np.cumsum(lens.to_numpy()))
    at = np.asarray(taken.offsets)[ends] if len(codes) else np.zeros(len(ends), np.int32)
    out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), taken.values if len(codes) else pa.array([], pa.int32()))
    return pa.table([docs, out], names=["doc_id", "ids"])


def _counts(left: pa.Table, right: pa.Table) -> pa.Table:
    docs, lens, codes, ids = _gather(left, right)
    size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.append(0, np.cumsum(size[codes] if len(codes) else np.zeros(0, np.int64)))
    ends = np.append(0, np.cumsum(lens.to_numpy()))
    return pa.table([docs, pa.array(total[ends[1:]] - total[ends[:-1]])], names=["doc_id", "n_tokens"])


def _encoded(docs: DataFrame, doc: str, text: str, folder: str, finish, schema: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    holds = F.contains(whole, F.lit(MARK))
    at_spaces = F.replace(whole, F.lit(" "), F.lit(MARK + " "))
    marked = F.when(holds, F.lit("")).when(whole.rlike(BY_PATTERN), F.regexp_replace(whole, PATTERN, MARK + "$0")).otherwise(at_spaces)
    words = F.when(holds, F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0)))
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), marked.alias("marked"), words.alias("words"))
    chunks = Saved(rows.mapInArrow(_chunks, f"chunk bigint, i int, word string, docs array<{kind}>, lens array<int>, codes binary"), "chunks")

    def encode(batches):
        tokenizer = encoder(folder)
        for batch in batches:
            ids = [tokenizer.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    listed = chunks.df.where("i >= 0").select("chunk", "i", "word")
    table = listed.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")
    back = listed.join(table, "word").select("chunk", "i", "ids")
    coded = chunks.df.where("i < 0").select("chunk", "docs", "lens", "codes")
    return coded.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(finish, schema.format(kind)).withColumnRenamed("doc_id", doc)


def encode(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(doc, ids): the token ids of each text without special tokens.

    Null and empty texts have an empty list. Every row of `docs` comes out once, also with a null or repeated doc; other columns may have any
    names. No rows give no rows.
    """
    return _encoded(docs, doc, text, folder, _ids, "doc_id {}, ids array<int>")


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(doc, n_tokens): the lengths of encode's lists, without building them."""
    return _encoded(docs, doc, text, folder, _counts, "doc_id {}, n_tokens bigint")


def vocabulary(spark: SparkSession, folder: str = TOKENIZERS) -> DataFrame:
    """(word, piece): the id-to-piece table, one row for each id of the vocabulary."""
    known = ranks(folder)
    return spark.createDataFrame(pa.table([pa.array(known.values(), pa.int32()), pa.array(known.keys(), pa.binary())], names=["word", "piece"]))


def _texts(left: pa.Table, right: pa.Table) -> pa.Table:
    docs, lens, codes, pieces = _gather(left, right, "piece")
    if pieces.null_count:
        raise ValueError("ids that the vocabulary doesn't have")
    ends = np.append(0, np.cumsum(lens.to_numpy())).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pieces.take(pa.array(codes)))
    joined = pc.binary_join(lists, b"")
    try:
        text = joined.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
    return pa.table([docs, text], names=["doc_id", "text"])


def decode(encoded: DataFrame, doc: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """(doc, text): the text of each list of ids, by a join with the id-to-piece table of the vocabulary.

    As in encoding, a chunk of documents keeps its ids as positions in its list of distinct ids, and only those lists are joined. A null or empty
    list gives the empty text; bytes that are no UTF-8 become U+FFFD; an id outside of the table fails. Every row comes out once.
    """
    kind = encoded.schema[doc].dataType.simpleString()
    rows = encoded.select(F.col(doc).alias("doc"), F.col(ids).cast("array<int>").alias("ids"))
    chunks = rows.mapInArrow(partial(_chunks, parts=_listed_ids), f"chunk bigint, i int, word int, docs array<{kind}>, lens array<int>, codes binary")
    chunks = Saved(chunks, "id-chunks")
    pieces = Saved(vocabulary(encoded.sparkSession, folder), "vocabulary")
    back = chunks.df.where("i >= 0").select("chunk", "i", "word").join(small_side(pieces), "word", "left").select("chunk", "i", "piece")
    coded = chunks.df.where("i < 0").select("chunk", "docs", "lens", "codes")
    texts = coded.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_texts, f"doc_id {kind}, text string")
    return texts.withColumnRenamed("doc_id", doc)
