"""Alignment of two versions of a text by common blocks: matched share, first differences, greedy cover."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

from casemill.runtime import arrow_safe


def matched_words(flow: list[str], witness: list[str], least: int) -> int:
    """How many words of the witness stand in common blocks of at least least words, in the order of the flow."""
    return sum(m.size for m in SequenceMatcher(None, flow, witness, autojunk=False).get_matching_blocks() if m.size >= least)


def differences(a: list[str], b: list[str], most: int) -> list[str]:
    """The first differences of two lists of words: what one has and what the other has in its place."""
    found = (f"{' '.join(a[i:j])} -> {' '.join(b[k:m])}" for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal")
    return [text for text, _ in zip(found, range(most), strict=False)]


def cover(whole: str, part: str) -> tuple[list[int], int]:
    """Lengths of the longest pieces of part, from its beginning on, that stand anywhere in whole, and how many characters
    stand nowhere. A piece of a piece in whole stands there too, so its length is found by halving."""
    sizes, lost, at = [], 0, 0
    while at < len(part):
        good, bad = 0, len(part) - at + 1
        while bad - good > 1:
            middle = (good + bad) // 2
            good, bad = (middle, bad) if part[at : at + middle] in whole else (good, middle)
        if good:
            sizes.append(good)
        lost += not good
        at += max(good, 1)
    return sizes, lost


def align(pairs: DataFrame, key: str, flow: str, witness: str, least: int = 5, most: int = 3) -> DataFrame:
    """(key, words, matched, share, differences, pieces, lost): how far a witness bears out a flow of text.

    words of the witness, those in common blocks of at least least words and their share (null for a witness without
    words), the first differences, and the pieces of the witness that cover it and the characters that stand nowhere in the
    flow. A null text counts as empty. Work is done pair by pair, a batch at a time.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, a, w in zip(b.key, b.flow, b.witness, strict=True):
                a, w = " ".join((a or "").split()), " ".join((w or "").split())
                x, y = a.split(), w.split()
                matched, (sizes, lost) = matched_words(x, y, least), cover(a, w)
                out.append((k, len(y), matched, matched / len(y) if y else None, differences(x, y, most), len(sizes), lost))
            yield pd.DataFrame(out, columns=["key", "words", "matched", "share", "differences", "pieces", "lost"])

    rows = pairs.selectExpr(f"`{key}` as key", f"cast(`{flow}` as string) as flow", f"cast(`{witness}` as string) as witness")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(arrow_safe(compare), f"key {kind}, words int, matched int, share double, differences array<string>, pieces int, lost int").withColumnRenamed("key", key)
