"""Byte-level BPE vocabularies read from public files. The files' contents travel by broadcast: a vocabulary is of fixed size."""

from __future__ import annotations

import base64
import json

import public_tokenizers
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

_BUILT: dict[int, tiktoken.Encoding] = {}


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The (ranks, special tokens) of a vocabulary file (.tiktoken or .json) for all executors."""
    with open(path, "rb") as f:
        content = f.read()
    return spark.sparkContext.broadcast((ranks(content), special_tokens(content)))


def special_tokens(content: bytes) -> dict[str, int]:
    """The ids of the strings that a .json file's library takes out of a text before it encodes the rest; others have none."""
    added = json.loads(content).get("added_tokens", []) if content.lstrip()[:1] == b"{" else []
    return {t["content"]: t["id"] for t in added if t["special"]}


def ranks(content: bytes) -> dict[bytes, int]:
    if content.lstrip()[:1] == b"{":
        letters = {c: b for b, c in _byte_letters().items()}
        spec = json.loads(content)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        return {bytes(map(letters.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encoding(shipped: Broadcast) -> tiktoken.Encoding:
    """One encoder for each process and vocabulary."""
    key = shipped._bid if hasattr(shipped, "_bid") else id(shipped)
    if key not in _BUILT:
        _BUILT[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=shipped.value[0], special_tokens=shipped.value[1])
    return _BUILT[key]
