"""SentencePiece BPE encoding by a table of prefixes, and decoding.

For merge-type vocabularies the encoding of a text's prefix ends in one certain token. The table holds
that token for every prefix: an automaton lists the pieces that end at a position, longest first, and
the right one is the piece that is compatible with the last token of the prefix before it, i.e. the two
stay apart when merged as a pair. The ids are then read backwards from the end. The cost is linear in
the text, also for texts without any space.

Pieces hold the space mark only at their start, so a text falls into chunks before each run of marks,
which encode independently, and before each newline where no piece holds one with other characters.
Repeated chunks are remembered, up to a number of bytes per worker; long ones (texts without spaces) never.

Defined results: a null text counts as empty and has no tokens; decoded text is ''. Rows are mapped one
to one, so repeated rows stay repeated; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .recent import Recent, Rest

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: At most so many verdicts on neighbouring pieces are remembered (both are short).
PAIRS = 200_000
#: Rows whose texts and ids are held at once.
ROWS = 500
TAIL = ".,;:!?*%#&$@"
#: Output columns and their Spark types.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
#: How each is made of the comma-joined ids and the decoded text.
MAKE = {
    "n_tokens": lambda ids, text: ids.count(",") + 1 if ids else 0,
    "ids": lambda ids, text: np.fromstring(ids, np.int32, sep=","),
    "decoded": lambda ids, text: text,
    "ids_sha256": lambda ids, text: hashlib.sha256(ids.encode()).hexdigest(),
    "decoded_sha256": lambda ids, text: hashlib.sha256(text.encode()).hexdigest(),
}


class PieceModel:
    """Encoder and decoder for one model file (merge type, identity normaliser, byte fallback)."""

    def __init__(self, path: str, remembered: int = 128 << 20):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not trainer.byte_fallback:
            raise ValueError("only merge-type models with the identity normaliser, a dummy prefix and byte fallback are supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        if any(p.type in (4, 5) for p in model.pieces) or len(self.byte_ids) != 256:
            raise ValueError("user-defined or unused pieces, or missing byte pieces")
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece holds the space mark after other characters, or more than one before them")
        self.splits_lines = not any("\n" in p and len(p) > 1 for p in self.ids)
        plain = sorted((p for p in self.ids if p.strip(MARK)), key=self.score.__getitem__, reverse=True)
        if len({self.score[p] for p in plain}) < len(plain):
            raise ValueError("pieces tie in score")
        #: Neighbouring characters that a piece may hold; no merge crosses others.
        self.bigrams = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Order in which merges are made; single characters are there from the start.
        self.order = {p: i for i, p in enumerate(plain) if len(p) > 1}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if p == MARK or p.strip(MARK) and (len(p) == 1 or self.split(p)):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.names = {p: str(i) for p, i in self.ids.items()}
        self.spoken = {str(i): p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {str(i): bytes([b]) for b, i in self.byte_ids.items()}
        self.neighbours: dict[str, bool] = {}
        self.rest = Rest(self.forget)
        self.chunks = Recent(remembered, self._values)

    def forget(self) -> None:
        self.chunks.clear()
        self.neighbours.clear()
        model_of.cache_clear()

    def split(self, token: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; None if merging never arrives at it."""
        if token not in self.halves:
            symbols = list(token)
            while len(symbols) > 2:
                at = min(range(len(symbols) - 1), key=lambda i: self.order.get(symbols[i] + symbols[i + 1], 1 << 30))
                if symbols[at] + symbols[at + 1] not in self.order:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.halves[token] = (symbols[0], symbols[1]) if len(symbols) == 2 else None
        return self.halves[token]

    def apart(self, a: str, b: str) -> bool:
        """Whether neighbours a and b stay as they are.

        Their merges are undone, latest first. If the parts that then face each other could have merged
        before the merge just undone, they would have. Of equal merges the left one comes first.
        """
        get = self.order.get
        now = 1 << 30
        while True:
            if get(a + b, 1 << 30) < now:
                return False
            of_a, of_b = get(a, -1), get(b, -1)
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                now, a = of_a, self.halves[a][1] if a in self.halves else self.split(a)[1]
            else:
                now, b = of_b + 1, self.halves[b][0] if b in self.halves else self.split(b)[0]

    def _run(self, n: int) -> list[str]:
        """A run of space marks. Its pieces tie in score, so they grow from the left instead."""
        out: list[str] = []
        left = n
        while left:
            piece, used = MARK, 1
            while used < left:
                step = next((k for k in range(1, left - used + 1) if piece + MARK * k in self.ids and self._grows(k)), 0)
                if not step:
                    break
                piece, used = piece + MARK * step, used + step
            out.append(piece)
            left -= used
        return out

    def _grows(self, n: int) -> bool:
        return all(MARK * k in self.ids for k in range(1, n + 1))

    def tokens(self, chunk: str) -> list[str]:
        """Pieces of a chunk with at most one space mark, at its start; unknown characters stay single."""
        last = [""]
        add, apart, known = last.append, self.apart, self.neighbours
        ends = self.automaton.iter(chunk)
        end, token = next(ends, (-1, ""))
        for at, char in enumerate(chunk):
            found = char
            while end == at:
                before = last[at + 1 - len(token)]
                if found is char:
                    if not before:
                        found = token
                    else:
                        good = known.get(pair := before + "\n" + token)
                        if good is None:
                            if len(known) >= PAIRS:
                                known.clear()
                            good = known[pair] = apart(before, token)
                        if good:
                            found = token
                end, token = next(ends, (-1, ""))
            add(found)
        out, e = [], len(chunk)
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def _pieces(self, key: str) -> list[str]:
        body = key.lstrip(MARK)
        run = len(key) - len(body)
        if run == 1 and "\n" not in body:
            return self.tokens(key)
        lines = re.split("(\n)", body) if self.splits_lines else [body]
        lines[0] = MARK * (run > 0) + lines[0]
        pieces = [p for line in lines for p in self.tokens(line)]
        if run > 1:
            return self._run(run) + pieces[1:] if pieces[0] == MARK else self._run(run - 1) + pieces
        return pieces

    def _value(self, key: str) -> str:
        """The ids of one chunk as decimal text, joined by commas."""
        ids: list[str] = []
        for p in self._pieces(key):
            i = self.names.get(p)
            if i is None:
                ids += [str(self.byte_ids[b]) for b in p.encode()]
            else:
                ids.append(i)
        return ",".join(ids)

    def _values(self, keys: list[str]) -> dict[str, str]:
        """Values of new chunks. Signs at the end are cut off where no piece holds both neighbours of the cut."""
        found: dict[str, str] = {}

        def value(key: str) -> str:
            known = found.get(key) or self.chunks.known(key)
            if known is None:
                known = found[key] = self._value(key)
            return known

        for k in keys:
            bare = k.rstrip(TAIL)
            if len(bare) > 1 and bare != k and bare[-1] + k[len(bare)] not in self.bigrams:
                found[k] = value(bare) + "," + value(k[len(bare) :])
            elif k not in found:
                found[k] = self._value(k)
        return found

    def encode_texts(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids as decimal text, joined by commas."""
        for text in texts:
            if not text:
                yield ""
                continue
            if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
                keys = CHUNK.findall(MARK + text.replace(" ", MARK))
            else:
                spaced = MARK + text.replace(" ", " " + MARK)
                keys = (spaced.replace("\n", " \n") if self.splits_lines else spaced).split(" ")
            yield ",".join(self.chunks.values(keys))

    def encode(self, text: str) -> list[int]:
        joined = next(self.encode_texts([text]))
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, joined: str) -> str:
        """The text of comma-joined ids: pieces in a row, bytes read as UTF-8, without the first space mark."""
        if not joined:
            return ""
        spoken = self.spoken
        text = b"".join([spoken[i] for i in joined.split(",")]).decode("utf-8", errors="replace")
        return text[1:] if text[:1] == " " else text

@lru_cache(maxsize=1)
def model_of(path: str) -> PieceModel:
    """One model for each Python worker, which serves many tasks."""
    return PieceModel(path)


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """One row per input row: the id and the chosen OUTPUTS of its whole text.

    Everything happens inside the scan's partitions; there is no shuffle.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{o} {OUTPUTS[o]}" for o in outputs)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        decodes = any(o.startswith("decoded") for o in outputs)
        with model.rest:
            for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
                found: dict[str, list] = {o: [] for o in outputs}
                for joined in model.encode_texts(batch.column(1).to_pylist()):
                    decoded = model.decode(joined) if decodes else ""
                    for o, values in found.items():
                        values.append(MAKE[o](joined, decoded))
                types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[o], types.get(o, pa.string())) for o in outputs)], ["id", *outputs])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    import public_tokenizers

    from .common import documents

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
