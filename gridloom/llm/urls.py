"""URL filters: all glob rules at once, by a bit-parallel Shift-And automaton.

A rule is a host suffix and a path prefix (`example.com/en/`), or a glob over the canonical URL `.host/path`: `*` is
any run without a slash, `**` any run at all, everything else itself. The globs' letters lie one after the other in
the bits of one multiword mask; one step a byte moves every pattern on every URL of a batch: states shift by one
and are held to the masks of the byte, while positions before a star stay where they are.

Canonical form: the host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path is
what follows up to `?`, `#` or the end. A URL that is null or has no `://` has an empty host and path. The longest
fitting rule decides; where none fits, the globs do; where none matches, `otherwise` does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Where no rule fits: hosts that name what they sell, and trackers.
GLOBS = ("**casino**", "**pills**", "**free-bets**", "**spam-farm**", "**ads-track**")
SLASH = ord("/")


@dataclass(frozen=True)
class Automaton:
    """Masks for each byte, in 64-bit words: step (states a byte may enter), stay (states a byte may keep)."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    finals: np.ndarray
    free: np.ndarray

    @classmethod
    def of(cls, globs: Sequence[str]) -> Automaton:
        letters: list[int | None] = []
        stars: dict[int, int] = {}
        starts, finals = [], []
        for glob in globs:
            starts.append(len(letters))
            letters.append(None)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i] == ord("*"):
                    deep = raw[i : i + 2] == b"**"
                    stars[len(letters) - 1] = max(stars.get(len(letters) - 1, 0), 1 + deep)
                    i += 1 + deep
                else:
                    letters.append(raw[i])
                    i += 1
            finals.append(len(letters) - 1)
        words = max(1, -(-len(letters) // 64))
        step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        bit = lambda k: np.uint64(1 << (k % 64))
        for k, c in enumerate(letters):
            if c is not None:
                step[c, k // 64] |= bit(k)
        for k, depth in stars.items():
            stay[:, k // 64] |= bit(k)
            if depth == 1:
                stay[SLASH, k // 64] &= ~bit(k)
        start = np.zeros(words, np.uint64)
        for k in starts:
            start[k // 64] |= bit(k)
        free = np.zeros(words, np.uint64)
        for k, depth in stars.items():
            if depth == 2 and k in finals:
                free[k // 64] |= bit(k)
        return cls(step, stay, start, np.array(finals, np.int64), free)

    def matches(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text a row of booleans, one for each glob. Only texts that still have bytes are moved on."""
        length = np.diff(off)
        order = np.argsort(-length, kind="stable")
        at, left = off[:-1][order], length[order]
        states = np.tile(self.start, (len(order), 1))
        alive = len(order)
        for t in range(int(left[0]) if len(left) else 0):
            while alive and left[alive - 1] <= t:
                alive -= 1
            live = states[:alive]
            # once every state is dead, or all that are left accept whatever follows, nothing changes any more
            if t % 64 == 63 and not (live & ~self.free).any():
                break
            byte = buf[at[:alive] + t]
            moved = live << np.uint64(1)
            moved[:, 1:] |= live[:, :-1] >> np.uint64(63)
            states[:alive] = (moved & self.step[byte]) | (live & self.stay[byte])
        out = np.empty((len(order), len(self.finals)), bool)
        out[order] = (states[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & np.uint64(1)
        return out


def canonical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.col(url_col).cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format(f"cast(`{url_col}` as string)")))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def judge(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[str] = GLOBS, otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict. No shuffle; the rules' masks travel with the task. Columns with these names are replaced."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    automaton = Automaton.of([f"*.{host}{path}**" for _, host, path in ranked] + list(globs))
    names, says = [host + path for _, host, path in ranked], [v for v, _, _ in ranked]

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = automaton.matches(*buffers(batch.column("__canonical")))
            ruled = hits[:, : len(names)]
            first = np.where(ruled.any(1), ruled.argmax(1), len(names))
            globbed = np.where(hits[:, len(names) :].any(1), "block", otherwise)
            verdict = np.where(first < len(names), np.array([*says, ""])[first], globbed)
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            del out["__canonical"]
            out |= {"rule": pa.array([*names, None]).take(pa.array(first)), "verdict": pa.array(verdict, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kept = canonical(df, url_col).drop("rule", "verdict")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", rule string, verdict string"
    return kept.withColumn("__canonical", F.encode(F.concat(F.lit("."), "host", "path"), "UTF-8")).mapInArrow(verdicts, schema)
