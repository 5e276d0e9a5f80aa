"""Chat formatting by token-level assembly.

Each turn's segments are encoded separately and reserved ids are spliced between them, so that no text can make a
reserved id. Control strings inside texts are escaped reversibly before they are encoded (a backslash after their first
character; backslashes are doubled), so the formatted text is free of them too. The loss mask comes from prefix sums
of +1 and -1 at the ends of the trained segments.

The template: a user turn is ``[INST]text[/INST]``, a system turn ``<<SYS>>text<</SYS>>``, an assistant turn
``<s>text</s>``, and any other role ``[ROLE]role[/ROLE]text</s>``. Only the assistant's texts are trained on.

Defined results: null texts and roles count as empty; turns of a conversation are in order of turn (null first), then
role, then text, so ties and repeated rows have a fixed order and all are kept. Rows with a null conversation id form one
conversation. An empty table gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, default_path
from .common import ship

#: Fixed values of the template; their ids follow the vocabulary's in this order.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)
OPEN = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
TRAINED = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """Encodes segments and reads ids back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        number = {s: b for b, s in enumerate(Vocabulary._byte_signs())}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.data: dict[int, bytes] = {}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for sign, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.data[i] = sign.encode() if sign in special else bytes(number[c] for c in sign)
        self.reserved = {c: size + i for i, c in enumerate(CONTROLS)}
        self.control = {i: c for c, i in self.reserved.items()}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def turn(self, role: str, text: str) -> tuple[list[int], np.ndarray]:
        """The ids of one turn and its loss mask."""
        body = self.encode(escape(text))
        if role in OPEN:
            first, last = OPEN[role]
            segments = [([self.reserved[first]], 0), (body, role == TRAINED), ([self.reserved[last]], 0)]
        else:
            segments = [([self.reserved["[ROLE]"]], 0), (self.encode(escape(role)), 0), ([self.reserved["[/ROLE]"]], 0), (body, 0), ([self.reserved["</s>"]], 0)]
        ends = np.cumsum([len(ids) for ids, _ in segments])
        change = np.zeros(ends[-1] + 1, np.int64)
        for end, (ids, trained) in zip(ends, segments):
            change[end - len(ids)] += int(trained)
            change[end] -= int(trained)
        return [i for ids, _ in segments for i in ids], np.cumsum(change)[:-1].astype(np.int8)

    def text(self, ids) -> str:
        """The formatted text of ids."""
        out, held = [], []
        for i in ids:
            if i in self.control:
                out += [b"".join(held).decode("utf-8", "replace"), self.control[i]]
                held = []
            else:
                held.append(self.data[i])
        return "".join(out) + b"".join(held).decode("utf-8", "replace")

    def read(self, ids, mask) -> tuple[str, str, str]:
        """Role, text and the text under the mask (unescaped) of one turn, from its ids alone."""
        first = self.control[ids[0]]
        plain = lambda x: unescape(b"".join([self.data[i] for i in x if i not in self.control]).decode("utf-8", "replace"))
        trained = plain([i for i, m in zip(ids, mask) if m])
        for role, (start, _) in OPEN.items():
            if start == first:
                return role, plain(ids), trained
        at = list(ids).index(self.reserved["[/ROLE]"])
        return plain(ids[:at]), plain(ids[at:]), trained


_CODECS: dict[str, Codec] = {}


def _codec(path: str | None) -> Codec:
    from tidewright.llm import chat

    where = path or default_path("byte_bpe_50k.json")
    return chat._CODECS.get(where) or chat._CODECS.setdefault(where, chat.Codec(where))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per turn, the turns of a conversation in order in one partition.

    Columns: conv_id, position (from 0), ids, loss_mask, token_start and char_start (prefix sums within the conversation),
    chars. Encoding happens before the shuffle; afterwards a conversation streams through its task row by row.
    """
    ship(turns.sparkSession)
    own = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(tokenizer)
        for b in batches:
            made = [codec.turn(r, t) for r, t in zip(b["role"], b["text"])]
            yield pd.DataFrame(
                {
                    "conv_id": b["conv_id"].astype("Int64"), "turn": b["turn"].astype("Int64"), "role": b["role"], "text": b["text"],
                    "ids": [ids for ids, _ in made], "loss_mask": [m for _, m in made], "chars": [len(codec.text(ids)) for ids, _ in made],
                }
            )

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv_id, position, tokens, chars = object(), 0, 0, 0
        for b in batches:
            rows = []
            for c, ids, mask, n in zip(b["conv_id"].astype("Int64"), b["ids"], b["loss_mask"], b["chars"]):
                c = None if c is pd.NA else int(c)
                if c != conv_id:
                    conv_id, position, tokens, chars = c, 0, 0, 0
                rows.append((c, position, ids, mask, tokens, chars, n))
                position, tokens, chars = position + 1, tokens + len(ids), chars + n
            yield pd.DataFrame(rows, columns=["conv_id", "position", "ids", "loss_mask", "token_start", "char_start", "chars"]).astype({"conv_id": "Int64"})

    encoded = own.mapInPandas(encode, "conv_id long, turn long, role string, text string, ids array<int>, loss_mask array<tinyint>, chars long")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "loss_mask", "chars").mapInPandas(offsets, "conv_id long, position long, ids array<int>, loss_mask array<tinyint>, token_start long, char_start long, chars long")


def digest(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, read back from the output of ``format_turns`` (in its order): counts and hashes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(tokenizer)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        state = None

        def row():
            c, n, turns, chars, loss, total, tokens = state
            return (c, n, turns.hexdigest(), chars, loss.hexdigest(), total, tokens)

        for b in batches:
            out = []
            for c, position, ids, mask in zip(b["conv_id"].astype("Int64"), b["position"], b["ids"], b["loss_mask"]):
                c = None if c is pd.NA else int(c)
                if position == 0:
                    if state:
                        out.append(row())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = ids.tolist()
                role, text, trained = codec.read(ids, mask)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(trained)
                state[4].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += len(codec.text(ids))
                state[6] += len(ids)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "position", "ids", "loss_mask").mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
