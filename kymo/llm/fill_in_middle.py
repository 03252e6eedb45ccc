"""Fill-in-the-middle: texts cut at two random token boundaries and reordered around markers, and put together again.

A token is a run of the letters A-Z and a-z or any one other character. A text becomes an array of code points (UTF-32);
neighbours that are both letters belong together, every other place between two code points is a boundary, and
``flatnonzero`` lists these. The drawn boundaries are looked up in that list, and the pieces are slices of the array,
encoded again.

Draws come from the SHA-256 of "seed:key": its first four groups of 8 hex digits pick the two cuts, whether the text stays plain and
which of the two orders it takes, so a text keeps its form whatever else is in the table and however it is partitioned.

Results: null counts as the empty text, which stays plain, as does a text that contains a marker. A null key draws as
"seed:". Repeated rows give repeated results. Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import map_rows, tune, whole_key

SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20
MARKERS = ("<P>", "<S>", "<M>")


def token_ends(points: np.ndarray) -> np.ndarray:
    """Places behind 0, 1, ... all tokens of a text of code points: the first is 0, the last the text's length."""
    lower = points | 32
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    cuts = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], cuts, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(seed: int, key: int | None) -> list[int]:
    """Four unsigned 32-bit numbers for a key."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
              markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every text; ``n`` counts tokens, the other two code points.

    Of 100 draws those from ``plain_from`` on leave a text plain; of the rest, ``spm_below`` in 100 put the suffix first
    (spm), the others the prefix (psm). Keys are whole numbers. Markers differ, are not empty and begin with a
    character that occurs in none of them again, so that no end of a piece can make another marker with what follows.
    """
    before, behind, between = markers
    if len({*markers}) < 3 or not all(markers) or any(m[0] in other[1:] for m in markers for other in markers):
        raise ValueError(f"{markers} must be three markers whose first characters occur only there")
    tune(df.sparkSession)

    def one(key: int | None, value: str) -> tuple:
        points = np.frombuffer(value.encode("utf-32-le"), np.uint32)
        ends = token_ends(points)
        n = len(ends) - 1
        h = draws(seed, key)
        if not n or any(m in value for m in markers) or h[2] % 100 >= plain_from:
            return n, "plain", None, None, value
        low, high = sorted(int(ends[x % (n + 1)]) for x in h[:2])
        prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:low], points[low:high], points[high:]))
        if h[3] % 100 < spm_below:
            return n, "spm", low, high - low, f"{behind}{suffix}{before}{prefix}{between}{middle}"
        return n, "psm", low, high - low, f"{before}{prefix}{behind}{suffix}{between}{middle}"

    def per_batch(columns: dict) -> dict:
        rows = [one(k, t.as_py() or "") for k, t in zip(columns["key"].to_pylist(), columns["text"])]
        return {"key": columns["key"]} | {name: [r[i] for r in rows] for i, name in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}

    schema = "key long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_rows(df.select(whole_key(df, key).alias("key"), df[text].alias("text")), per_batch, schema).withColumnRenamed("key", key)


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``transform`` cut, from its output and form alone: built-in functions, no Python."""
    cut = F.split(F.col(output), "|".join(re.escape(m) for m in markers), -1)  # nothing, then the three pieces
    first, second, middle = (cut[i] for i in (1, 2, 3))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
