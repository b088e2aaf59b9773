"""Byte-level BPE as a streaming transducer, and decoding as an incremental state machine (operator 11).

Merging is defined over a whole word: a pair far to the right may still undo what stands to the left. How far is bounded by
the merge list. `MergeList.lookahead` computes a bound; the transducer reads one byte at a time, keeps only the bytes whose
tokens later bytes may still change (its state), and emits tokens once they are stable. States and transitions are learnt
when first met, in tables of bounded size, so memory is constant however long a text or a word is.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks
from .tokens import BYTE_SIGNS, PLAIN, SAFE_CUT

#: What splits text into words before merging, as byte-level tokenizer files mean it (a fixed value of their format).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*"), "S": regex.compile(r"\s*")}
#: The last place before which words always end, in a text's last characters.
LAST_CUT = re.compile(r"(?<=\S) (?=\S+$)")
#: A character of each class, none of them part of a contraction.
STAND_INS = {"L": "a", "N": "1", "O": "#", "S": "\n"}
#: Characters of a text that are looked at in one go, of a word that is held until it ends, and of a word worth keeping.
PIECE, LONG_WORD, KEPT_WORD = 1 << 16, 1 << 12, 64
NEVER = 1 << 60


def _byte_of_sign() -> dict[str, int]:
    return {chr(BYTE_SIGNS.get(b, b)): b for b in range(256)}


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes that each id of a byte-level tokenizer file stands for."""
    sign = _byte_of_sign()
    named = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
    return {i: bytes(map(sign.__getitem__, t)) if all(c in sign for c in t) else t.encode() for t, i in named}


class MergeList:
    """The rules of a byte-level BPE file: which tokens there are, what they are made of, and when (the rule's rank)."""

    def __init__(self, path: str):
        spec = _read(path)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            raise ValueError("a plain byte-level BPE file is needed")
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level pre-tokenizer without normaliser and prefix space is needed")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with rules of their own are not supported")
        sign, vocab = _byte_of_sign(), model["vocab"]
        self.bytes_of = token_bytes(spec)
        #: Two neighbouring tokens -> (rank, the token that they become).
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        self.made, self.parts = {vocab[c]: -1 for c in sign}, {}
        for rank, rule in enumerate(model["merges"]):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if left not in self.made or right not in self.made or whole in self.made:
                raise ValueError(f"rule {rank} uses a token before it is made, or makes one again")
            self.rules[left, right] = rank, whole
            self.made[whole], self.parts[whole] = rank, (left, right)
        self.tokens = {self.bytes_of[t]: t for t in self.made}
        self.longest = max(map(len, self.tokens))
        self._edges: dict[tuple[int, int], list[int]] = {}
        #: Only tokens that their own bytes become can ever be emitted.
        self.tokens = {text: t for text, t in self.tokens.items() if t not in self.parts or self._meet(*self.parts[t], self.made[t])}

    def lookahead(self) -> int:
        """Bytes after which a token can't change any more.

        Take two texts with a common beginning and apply the rules rank by rank. Left of some border both have the same
        tokens; at first the border is the beginning's end. A rule (u, v) moves it only by joining a u that ends there to a
        v behind it, in one text and not in the other, and then by the length of u. The next rule (u', v') that moves it has
        a higher rank, and its v' starts with u, for both texts hold u there and tokens only grow. So the border moves by no
        more than the largest sum of |u| over such chains of rules.
        """
        best: dict[bytes, int] = {}
        for (left, right), _ in sorted(self.rules.items(), key=lambda x: x[1]):
            u, v = self.bytes_of[left], self.bytes_of[right]
            moved = len(u) + max((best.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0)
            best[u] = max(moved, best.get(u, 0))
        return max(best.values(), default=0)

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at a token's left (0) or right (1) edge while it is made, from the byte up."""
        if (token, side) not in self._edges:
            below = self._edge(self.parts[token][side], side) if token in self.parts else []
            self._edges[token, side] = [*below, token]
        return self._edges[token, side]

    def _meet(self, left: int, right: int, until: int = NEVER) -> bool:
        """True if no rule of a rank below `until` joins parts of two neighbouring tokens while these are being made.

        A part is there from its own rank to that of the next part at its edge. At equal ranks the leftmost pair goes first.
        """
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            ends_a = self.made[a[i + 1]] if i + 1 < len(a) else NEVER
            ends_b = self.made[b[j + 1]] if j + 1 < len(b) else NEVER
            rank = self.rules.get((a[i], b[j]), (NEVER, 0))[0]
            if rank < ends_a and rank <= ends_b and rank < until:
                return False
            if ends_a == ends_b == NEVER:
                return True
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1

    def neighbours(self, left: int, right: int) -> bool:
        """True if two tokens can follow one another: their bytes together become just these two."""
        return self._meet(left, right)


class Transducer:
    """Bytes in, stable tokens out. A state is what is still open: its bytes, and the last token of each of its beginnings.

    A beginning's tokens are those of a shorter beginning and one more token, which fits if it and its neighbour can follow
    one another; just one does. Only beginnings that a token may still continue across the end matter: what their
    tokenizations have in common at the left is stable. `bound` is the most bytes that can be open.
    """

    def __init__(self, merges: MergeList, limit: int = 400_000):
        self.merges, self.limit = merges, limit
        self.bound = merges.lookahead() + 2 * merges.longest
        self.begins = {text[:i] for text in merges.tokens for i in range(1, len(text))}
        self._clear()

    def _clear(self) -> None:
        #: state << 8 | byte -> next state, or its complement if tokens are emitted (these are in `emits`).
        self.steps: dict[int, int] = {}
        self.emits: dict[int, list[int]] = {}
        #: Of each state: the open bytes, the last token of each beginning (by its length), and the beginnings that matter.
        self.numbers, self.open, self.ends, self.live = {b"": 0}, [b""], [[-1]], [[0]]
        self.rest: dict[int, list[int]] = {0: []}

    def renewed(self, state: int) -> int:
        """The number of the same state after the tables have been emptied, if they had grown too large."""
        if len(self.steps) < self.limit:
            return state
        held = self.open[state], self.ends[state], self.live[state]
        self._clear()
        return self._numbered(*held)

    def _numbered(self, held: bytes, ends: list[int], live: list[int]) -> int:
        if held not in self.numbers:
            self.numbers[held] = len(self.open)
            self.open.append(held)
            self.ends.append(ends)
            self.live.append(live)
        return self.numbers[held]

    def _path(self, ends: list[int], at: int, to: int = 0) -> list[int]:
        """The tokens between two places, last first."""
        found, bytes_of = [], self.merges.bytes_of
        while at > to:
            found.append(ends[at])
            at -= len(bytes_of[ends[at]])
        return found

    def _learn(self, state: int, byte: int) -> int:
        held, ends, tokens, bytes_of = self.open[state] + bytes((byte,)), self.ends[state], self.merges.tokens, self.merges.bytes_of
        n = len(held)
        for at in self.live[state]:
            token = tokens.get(held[at:])
            if token is not None and (at == 0 or self.merges.neighbours(ends[at], token)):
                break
        ends = [*ends, token]
        live = [at for at in self.live[state] if held[at:] in self.begins]
        live.append(n)
        met = set(live)
        while len(met) > 1:
            last = max(met)
            met.remove(last)
            met.add(last - len(bytes_of[ends[last]]))
        stable, key = met.pop(), state << 8 | byte
        if stable:
            self.emits[key] = self._path(ends, n)[::-1][: len(self._path(ends, stable))]
            held, ends, live = held[stable:], ends[stable:], [at - stable for at in live]
        after = self._numbered(held, ends, live)
        self.steps[key] = after = ~after if stable else after
        return after

    def feed(self, state: int, data: bytes, out: array) -> int:
        """Read bytes, append stable tokens to `out`; the state reached."""
        step = self.steps.get
        for byte in data:
            found = step(state << 8 | byte)
            if found is None:
                found = self._learn(state, byte)
            if found < 0:
                out.extend(self.emits[state << 8 | byte])
                found = ~found
            state = found
        return state

    def finish(self, state: int, out: array) -> None:
        """Append the tokens of what is still open: the word is over."""
        if state not in self.rest:
            self.rest[state] = self._path(self.ends[state], len(self.open[state]))[::-1]
        out.extend(self.rest[state])


class _Known(dict):
    """Piece of text -> its ids as bytes, from the transducer; short ones are kept until `limit` are known, twice."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.before = encode, limit, {}

    def __missing__(self, word: str) -> bytes | None:
        ids = self.before.get(word, False)
        if ids is False:
            ids = self.encode(word)
        if len(word) <= KEPT_WORD:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts as the tokenizers library does with the same file, without special tokens added.

    Added tokens that a text spells out get their ids. Which characters are letters, numbers or white space is what the
    library takes them for: it is asked once for each character met, as Unicode versions differ.
    """

    def __init__(self, path: str, cached_words: int = 400_000):
        from tokenizers.pre_tokenizers import ByteLevel

        self.merges = MergeList(path)
        self.transducer = Transducer(self.merges)
        self.words, self.chunks = _Known(self._word, cached_words // 8), _Known(self._chunk, cached_words)
        names = sorted(self.merges.added, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.starts = {x[:i] for x in names for i in range(1, len(x))}
        self.parts = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.seen, self.odd = {chr(i) for i in range(128)}, {}

    def _word(self, word: str) -> bytes:
        out = array("I")
        self.transducer.finish(self.transducer.feed(self.transducer.renewed(0), word.encode(), out), out)
        return out.tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of the chunk after a space; None if words may cross that space or the next one: white space stands there."""
        plain = PLAIN(chunk)
        if plain:
            stem, marks = plain.groups()
            return self.chunks[stem] + self.words[marks] if marks else self._word(f" {stem}")
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        words = self.split(f" {chunk}")
        return self.words[words[0]] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def whole(self, text: str) -> bytes:
        """Ids of a text that nothing follows, or a space between two visible characters: there words always end."""
        first, *chunks = text.split(" ")
        found = list(map(self.chunks.__getitem__, chunks))
        if None in found or first[-1:].isspace() or (chunks and not first):
            return b"".join([b"".join(map(self.words.__getitem__, self.split(x))) for x in SAFE_CUT.split(text)])
        return b"".join([*map(self.words.__getitem__, self.split(first)), *found])

    def _class(self, sign: str) -> str:
        """The library's class of a character: that of the run which it joins."""
        return next((k for k in "LNO" if len(self.parts(STAND_INS[k] + sign)) == 1), "S")

    def shown(self, text: str) -> str:
        """The text with stand-ins for characters that the library takes for another class than the pattern does."""
        if text.isascii():
            return text
        signs = set(text)
        for sign in signs - self.seen:
            taken = self._class(sign)
            if taken != next(k for k in "LNSO" if RUNS[k].match(sign).end()):
                self.odd[ord(sign)] = STAND_INS[taken]
            self.seen.add(sign)
        return text.translate(self.odd) if any(ord(sign) in self.odd for sign in signs) else text

    def split(self, text: str) -> list[str]:
        shown = self.shown(text)
        return WORDS.findall(text) if shown is text else [text[m.start() : m.end()] for m in WORDS.finditer(shown)]

    def encode(self, text: str | None) -> bytes:
        """A text's ids as unsigned 32-bit integers, read piece by piece. None counts as empty."""
        if not text:
            return b""
        stream = Stream(self)
        return b"".join([stream.feed(text[i : i + PIECE], i + PIECE >= len(text)) for i in range(0, len(text), PIECE)])


class Stream:
    """One text on its way through the encoder, in pieces of any size; it holds back no more than a long word's start."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.tail, self.held, self.run, self.state = encoder, "", "", "", 0

    def feed(self, piece: str, last: bool = False) -> bytes:
        """The ids that are certain once this piece has been read; all that are left if it is the last one."""
        added, text, out, at = self.encoder.added, self.tail + piece, [], 0
        for m in added.finditer(text) if added else ():
            out.append(self._words(text[at : m.start()], True))
            out.append(array("I", [self.encoder.merges.added[m[0]]]).tobytes())
            at = m.end()
        cut = len(text)
        if not last and added:
            cut = next((i for i in range(max(at, len(text) - max(map(len, self.encoder.merges.added))), len(text)) if text[i:] in self.encoder.starts), cut)
        self.tail = text[cut:]
        out.append(self._words(text[at:cut], last))
        return b"".join(out)

    def _words(self, text: str, last: bool) -> bytes:
        out = []
        text = self.held + text
        self.held = ""
        if self.run:
            taken, text = self._running(text, last)
            out.append(taken)
        if text and not self.run and last:
            out.append(self.encoder.whole(text))
        elif text and not self.run:
            cut = next((m.start() for m in LAST_CUT.finditer(text, max(0, len(text) - LONG_WORD))), 0)
            out.append(self.encoder.whole(text[:cut]))
            words = self.encoder.split(text[cut:])
            # A word at the end may go on; so may a contraction of which two characters have been read.
            back = 2 if words[-1] in ("r", "v", "l") and words[-2:-1] == ["'"] else 1
            self.held = "".join(words[-back:])
            out.extend(map(self.encoder.words.__getitem__, words[:-back]))
            if len(self.held) > LONG_WORD:
                shown = self.encoder.shown(self.held[-1])
                self.run = next(k for k in "LNSO" if RUNS[k].match(shown).end())
                self.state = 0
                text, self.held = self.held, ""
                out.append(self._running(text, False)[0])
        return b"".join(out)

    def _running(self, text: str, last: bool) -> tuple[bytes, str]:
        """Feed what of the text goes on with a long word; the ids, and the text after the word if it ends here.

        Of white space the last character belongs to what follows, unless nothing does.
        """
        machine, out = self.encoder.transducer, array("I")
        end = RUNS[self.run].match(self.encoder.shown(text), 1 if text[:1] == " " and not self.state else 0).end()
        over = last or end < len(text)
        stop = end - 1 if self.run == "S" and end and not (last and end == len(text)) else end
        data = text[:stop].encode()
        for i in range(0, len(data), LONG_WORD):
            self.state = machine.feed(machine.renewed(self.state), data[i : i + LONG_WORD], out)
        if over:
            machine.finish(self.state, out)
            self.run, self.state = "", 0
            return out.tobytes(), text[stop:]
        self.held = text[stop:]
        return out.tobytes(), ""


class _Table(dict):
    """Id -> bytes; ids without a token have none."""

    def __missing__(self, id_: int) -> bytes:
        return b""


class Decoder:
    """Ids in any portions -> text: bytes of unfinished characters wait for the next portion; what can't become a character
    gives U+FFFD, one for each longest beginning of one. Ids without a token are skipped."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of if isinstance(bytes_of, _Table) else _Table(bytes_of)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


_ENCODERS: dict[str, Encoder] = {}
_TABLES: dict[str, dict[int, bytes]] = {}


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, with what it has learnt in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (list of int) of each row's text, in the order of its tokens; other columns are ignored.

    Null and empty texts give empty lists; rows with equal or null doc_id stay apart; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for chunk in text_chunks(batches):
            ids = [encoder.encode(text) for text in chunk.column("text").to_pylist()]
            ends = [0]
            for x in ids:
                ends.append(ends[-1] + len(x) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def worker_table(path: str) -> dict[int, bytes]:
    if path not in _TABLES:
        _TABLES[path] = _Table(token_bytes(_read(path)))
    return _TABLES[path]


def portions(table: dict[int, bytes], ids: list[int], size: int = PIECE) -> Iterator[str]:
    """The text of some ids, portion by portion."""
    machine = Decoder(table)
    for i in range(0, len(ids), size):
        yield machine.feed(ids[i : i + size], i + size >= len(ids))


def _by_ids(batch: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    """Slices of a batch that hold about `limit` ids each, and these ids."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate([*sizes, 0]):
        held += n
        if held >= limit or i == len(sizes):
            part = batch.slice(first, min(i + 1, len(sizes)) - first)
            flat, at, lists = part.column("ids").flatten().to_numpy(zero_copy_only=False).tolist(), 0, []
            for size in sizes[first : first + part.num_rows]:
                lists.append(flat[at : at + size])
                at += size
            if lists:
                yield part, lists
            first, held = i + 1, 0


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The table with the text of its column ids in place of this column; other columns stay. Null ids give empty text."""
    others = [c for c in encoded.columns if c != "ids"]
    schema = T.StructType([*(encoded.schema[c] for c in others), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(tokenizer)
        for batch in batches:
            for part, lists in _by_ids(batch):
                texts = ["".join(portions(table, ids)) for ids in lists]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(texts, pa.string())], names=[*others, "text"])

    return encoded.select(*others, "ids").mapInArrow(run, schema)


def round_trip_digest(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the decimal ids, joined by commas, and of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(tokenizer)
        decimal = [str(i) for i in range(max(table, default=0) + 1)].__getitem__
        for batch in batches:
            for part, lists in _by_ids(batch):
                out = []
                for ids in lists:
                    text, listed = hashlib.sha256(), hashlib.sha256()
                    for portion in portions(table, ids):
                        text.update(portion.encode())
                    for i in range(0, len(ids), PIECE):
                        listed.update((b"," if i else b"") + ",".join(map(decimal, ids[i : i + PIECE])).encode())
                    out.append((len(ids), listed.hexdigest(), text.hexdigest()))
                n, listed, text = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe_round_trip(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return round_trip_digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer), tokenizer)
