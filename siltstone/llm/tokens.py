"""Token ids: a cached word encoder over the tokenizers library, and token files in Parquet (operator 8)."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, text_chunks

#: Before a single space between two visible characters every byte-level pre-tokenizer starts a new word.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Latin letters (composed ones, which normalisation leaves alone), then marks that no pre-tokenizer joins to a letter.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|]*)").fullmatch
#: The visible signs that byte-level vocabularies write for bytes: printable Latin-1 as it is, the rest from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class _Words(dict):
    """Word (str: after a space; tuple: as it stands) -> its ids as bytes; learns a word when first asked for it.

    Words asked for in the last period or this one are kept; a period ends when it has seen `limit` words.
    """

    def __init__(self, encoded, limit: int):
        super().__init__()
        self.encoded, self.limit, self.before = encoded, limit, {}

    def __missing__(self, word):
        found = self.before.get(word, False)
        self[word] = found = self.encoded(word) if found is False else found
        return found

    def turn(self) -> None:
        if len(self) > self.limit:
            self.before = dict(self)
            self.clear()


class WordEncoder:
    """Encodes texts as the tokenizer file does, word by word with a bounded cache.

    Texts are only cut where no token can span. At spaces for a vocabulary that drops white space (`keeps_space=False`),
    before a space between visible characters for a byte-level one; words then at a single line feed between visible
    characters, and between a letter and the marks that end a word. The tokenizers library encodes each piece, so ids
    equal those of the whole text; for plain Latin words its model is called directly, without its offsets. A text where
    white space meets a space is cut by SAFE_CUT alone. Added tokens (such as an end mark) that a text spells out get
    their ids, as in the library: texts are cut there first; texts that may hold an added token with rules of its own
    (normalised, single word, stripped sides) are encoded whole.
    """

    def __init__(self, path: str, keeps_space: bool, cached_words: int = 420_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        by_rules = any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values())
        names = "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.may_hold = re.compile(names, re.IGNORECASE).search if by_rules else lambda text: any(x in text for x in self.added)
        self.cut_added = None if by_rules else re.compile(f"({names})").split
        self.keeps_space = keeps_space
        self.line_feed = array("I", self._whole("\n")).tobytes()
        self.words, self.marks = _Words(self._encoded, cached_words), {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _packed(self, text: str) -> bytes:
        return array("I", self._whole(text)).tobytes()

    def _letters(self, lead: str, stem: str) -> bytes:
        """Ids of Latin letters, which are one pre-token: straight from the library's model."""
        if stem.isascii():
            piece = "\u0120" + stem if lead else stem  # the sign for a space
        else:
            piece = (lead + stem).encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _marked(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._packed(marks)
        return self.marks[marks]

    def _encoded(self, word: str | tuple) -> bytes | None:
        """Ids of a word; None if its text can't be cut at the space before or after it."""
        if isinstance(word, tuple):
            return self._packed(word[0])
        lead = " " if self.keeps_space else ""
        plain = PLAIN(word)
        if plain:
            stem, marks = plain.groups()
            if not self.keeps_space:
                stem = stem.lower()
            if stem == word:
                return self._letters(lead, stem)
            return self.words[stem] + self._marked(marks) if marks else self.words[stem]
        lines = word.split("\n")
        if self.keeps_space:
            if not word or word[0].isspace() or word[-1].isspace():
                return None
            if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
                return self._packed(" " + word)
        out = []
        for i, line in enumerate(lines):
            plain = PLAIN(line)
            if i and self.keeps_space:
                out.append(self.line_feed)
                out.append(self._letters("", plain[1]) + (self._marked(plain[2]) if plain[2] else b"") if plain else self._packed(line))
            else:
                out.append(self.words[line] if plain else self._packed(lead + line))
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. None counts as empty."""
        self.words.turn()
        out = []
        for text in texts:
            if not text or not self.may_hold(text):
                out.append(self._text(text))
            elif self.cut_added is None:
                out.append(self._packed(text))
            else:
                out.append(b"".join(self.added[x] if i % 2 else self._text(x) for i, x in enumerate(self.cut_added(text))))
        return out

    def _text(self, text: str | None) -> bytes:
        ids = self.words.__getitem__
        row: list = text.split(" ") if text else []
        if not row or not self.keeps_space:
            return b"".join(map(ids, row))
        cut = row[0] and not row[0][-1].isspace()
        row[0] = (row[0],)
        if not cut or None in (found := list(map(ids, row))):
            found = [ids((p,)) for p in SAFE_CUT.split(text)]
        return b"".join(found)


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def worker_encoder(path: str, keeps_space: bool) -> WordEncoder:
    """The encoder of this Python worker, with what it has cached in earlier tasks."""
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = WordEncoder(path, keeps_space)
    return _ENCODERS[path, keeps_space]


def encode_documents(path: str, keeps_space: bool, end_id: int):
    """A function for mapInArrow that keeps doc_id and yields ids (with the end id) as lists, in the order given.

    Columns: doc_id, n_tokens, first_token (ids before the document in this partition), ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, end = worker_encoder(path, keeps_space), 0, array("I", [end_id]).tobytes()
        for chunk in text_chunks(batches, limit=2 << 20):
            texts = [ids + end for ids in encoder.encode(chunk.column("text").to_pylist())]
            size = np.array([len(t) // 4 for t in texts], np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = np.frombuffer(b"".join(texts), np.int32)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(before + ends[:-1]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "n_tokens", "first_token", "ids"],
            )
            before += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool = True, end_id: int = 2, row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10, file_bytes: int = 256 << 20) -> str:
    """Encode doc_id and text of `docs` and write them to `path`, in ascending doc_id order over all files.

    Range partitioning deals out the texts, about `file_bytes` of text a task and at least as many tasks as the session
    has shuffle partitions; each task encodes its range in order and writes one file. Ids are a list
    column with dictionary pages (16 bits an id for a vocabulary of 50,000); doc_id, n_tokens and first_token are
    delta-encoded. Row groups and pages are kept small, and the writer adds page indexes, so a reader can fetch the
    metadata columns, or the ids of a range of doc_id, alone. Other columns of docs are ignored. A null text has the
    end id only; null doc_ids come first; rows with equal doc_id are ordered by their text's hash. An empty table
    gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    ordered = keyed.repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    writer = ordered.mapInArrow(encode_documents(tokenizer, keeps_space, end_id), "doc_id long, n_tokens long, first_token long, ids array<int>").write
    for key, value in {
        "compression": "snappy", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#first_token": "false", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    return path


FILE_SCHEMA = "doc_id long, n_tokens long, first_token long, ids array<int>"


def _numbered(spark, path: str) -> DataFrame:
    """Rows of token files with the number of the task that wrote them: a task's files continue one another."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return spark.read.schema(FILE_SCHEMA).parquet(path).withColumn("task", number)


def _task_starts(rows: DataFrame) -> DataFrame:
    """The ids before each task's first: one row a task, from the metadata columns alone."""
    sizes = rows.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("task", F.coalesce(before, F.lit(0)).alias("before"))


def read_token_files(spark, path: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of token files; of a range of doc_id (both ends
    included) if given, which the files' row group statistics and page indexes narrow down."""
    rows = _numbered(spark, path)
    asked = rows if doc_ids is None else rows.where(F.col("doc_id").between(*doc_ids))
    return asked.join(_task_starts(rows), "task").select("doc_id", (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b].data) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), batch.column("first_token"), batch.column("task")], names=["doc_id", "n_tokens", "ids_crc32", "first_token", "task"])


def token_file_digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers), from the files."""
    rows = _numbered(spark, path)
    digest = rows.select("doc_id", "first_token", "ids", "task").mapInArrow(_crc, "doc_id long, n_tokens long, ids_crc32 long, first_token long, task long")
    return digest.join(_task_starts(rows), "task").select("doc_id", (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "tokens"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return token_file_digest(spark, path)
