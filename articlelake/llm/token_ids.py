"""Token ids of whole texts with a given tokenizer file.

Both supported kinds of file cut a text before they merge bytes, and never merge across a
cut. So a text is encoded unit by unit, and ids of a unit seen before come from a bounded
table. Units end only where the file's own rule is certain to cut; a file with another rule
is applied to whole texts. The library's merges are applied directly to unknown units of
plain ASCII, whose letters, digits and marks both rules cut in a known way.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_rows, text_or_empty

#: Units in each of a worker's two tables, and their longest length.
TABLE_UNITS = 500_000
UNIT_LENGTH = 48

_WHITE_RUN = re.compile(r"\s\s")
_CERTAIN_CUT = re.compile(r"(?<=\S)(?= \S)")
# Printable ASCII but space and apostrophe; byte-level files write these signs as themselves.
_PLAIN_UNIT = re.compile(r"[!-&(-~]+")
_PLAIN_PARTS = {
    "space before word": re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"),
    "white space removed": re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+"),
}
# How byte-level files write a space; normalizer steps that leave plain ASCII or lower it; contractions.
_SPACE_SIGN = "\u0120"
_HARMLESS = {"NFC", "Replace", "Lowercase"}
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d|"


class _Units(dict):
    """Ids of units as bytes; an unknown unit is encoded by the library.

    A full table becomes the old one, and units met again move on to the new one, so
    frequent units stay known.
    """

    def __init__(self, encode: Callable[[str], list[int]], lead: str = "") -> None:
        super().__init__()
        self.encode, self.lead = encode, lead
        self.old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = np.array(self.encode(self.lead + unit), dtype="<u4").tobytes()
        if len(unit) <= UNIT_LENGTH:
            if len(self) >= TABLE_UNITS:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class TextEncoder:
    """Encode whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            source = file.read()
        library = Tokenizer.from_str(source)
        library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = library.get_vocab_size(with_added_tokens=True)

        def ids(text: str) -> list[int]:
            return library.encode(text, add_special_tokens=False).ids

        self._ids = ids
        settings = json.loads(source)
        rule = cutting_rule(settings)
        of_unit = _merged(library.model, rule, settings, ids)
        self._plain, self._spaced = _Units(of_unit), _Units(of_unit, " ")
        self._encode = {"space before word": self._byte_level, "white space removed": self._words}.get(rule, self._whole)

    def __call__(self, text: str) -> bytes:
        return self._encode(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype="<u4").tobytes()

    def _words(self, text: str) -> bytes:
        return b"".join(map(self._plain.__getitem__, text.replace("\n", " ").split(" ")))

    def _byte_level(self, text: str) -> bytes:
        if _WHITE_RUN.search(text):
            return b"".join(map(self._plain.__getitem__, _CERTAIN_CUT.split(text)))
        found: list[bytes] = []
        for number, line in enumerate(text.split("\n")):
            if number:
                found.append(self._plain["\n"])
            first, *rest = line.split(" ")
            found.append(self._plain[first])
            found.extend(map(self._spaced.__getitem__, rest))
        return b"".join(found)


def _merged(model, rule: str, settings: dict, ids: Callable[[str], list[int]]) -> Callable[[str], list[int]]:
    """The ids of a unit: plain ones part by part by the file's merges, others by the whole library."""
    steps = settings.get("normalizer") or {}
    names = [s.get("type") for s in steps.get("normalizers", [steps] if steps else [])]
    replaced = [s for s in steps.get("normalizers", []) if s.get("type") == "Replace"]
    known = _HARMLESS.issuperset(names) and all(s.get("pattern") == {"Regex": "\\s+"} for s in replaced)
    if rule not in _PLAIN_PARTS or not known or settings.get("model", {}).get("type") != "BPE":
        return ids
    parts, lowers = _PLAIN_PARTS[rule].findall, "Lowercase" in names
    plain, tokens = _PLAIN_UNIT.fullmatch, model.tokenize

    def of_unit(unit: str) -> list[int]:
        spaced = unit.startswith(" ")
        if not plain(unit, 1 if spaced else 0):
            return ids(unit)
        body = unit[1:] if spaced else unit
        found = parts(body.lower() if lowers else body)
        if spaced:
            found[0] = _SPACE_SIGN + found[0]
        return [token.id for part in found for token in tokens(part)]

    return of_unit


def cutting_rule(settings: dict) -> str:
    """Which certain cuts a tokenizer file has, read from its settings."""
    cutter = settings.get("pre_tokenizer") or {}
    if cutter.get("type") == "ByteLevel" and not settings.get("normalizer"):
        if cutter.get("use_regex") and not cutter.get("add_prefix_space"):
            return "space before word"
    steps = cutter.get("pretokenizers") or [{}]
    first = steps[0]
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        kept = first.get("pattern", {}).get("Regex", "")
        rest = all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
        if rest and kept == _CONTRACTIONS + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return "white space removed"
    return "none"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """The encoder of a worker process; ``path`` must be readable on every executor."""
    return TextEncoder(path)


def packed(ids: bytes, vocabulary: int) -> bytes:
    """Ids as 16-bit numbers where all fit, else unchanged."""
    return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if vocabulary <= 1 << 16 else ids


def unpacked(data: bytes, vocabulary: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if vocabulary <= 1 << 16 else "<u4").astype(np.uint32)


def token_table(docs: DataFrame, path: str, end_id: int, vocabulary: int) -> DataFrame:
    """One row per document: doc_id, n_tokens with the end id, ids (packed), ids_crc32."""

    def start():
        encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()

        def rows(doc_id, text):
            ids = encode(text) + end
            yield doc_id, len(ids) // 4, packed(ids, vocabulary), zlib.crc32(ids)

        return rows

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_rows(frame, start, "doc_id long, n_tokens long, ids binary, ids_crc32 long")
