"""URL filters on a sorted array of digests.

Rules are a host and the beginning of a path; a rule fits its host, all subdomains,
and paths that begin with its own, and the longest rule wins. A rule's key is its
host and path; its 64-bit digest goes into a sorted array in one file, next to the
full keys and verdicts. Every task maps the file into memory, so the tasks of one
machine share its pages. A batch of URLs asks for all its host suffixes, each with
path beginnings of the lengths that rules have, by binary search for the whole batch
at once. The full key stored at the place must equal the one asked for; equal digests
of different keys lie side by side and are all looked at.

Spark deals the file to the executors (``SparkContext.addFile``). Rules are sorted on
the driver: the list is written by people, and ``MOST_BYTES`` of keys are its bound.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.llm.shared import ascii_lower

MOST_BYTES = 1 << 28
_MAGIC = 8


def digest_file(rules: Iterable[tuple[str, str]], folder: str) -> str:
    """Write rules (``host/path`` and verdict) as a sorted digest file; returns its path.

    Layout: lengths of the parts, then digests, offsets of keys, verdicts (1: block),
    and the keys. Of equal keys the last verdict holds.
    """
    verdicts = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
        verdicts[(host.lower() + slash + path).encode()] = verdict == "block"
    if sum(map(len, verdicts)) > MOST_BYTES:
        raise ValueError(f"rules take more than {MOST_BYTES} bytes")
    digests = {key: xxhash.xxh3_64_intdigest(key) for key in verdicts}
    keys = sorted(verdicts, key=lambda k: (digests[k], k))
    ends = np.cumsum([0, *map(len, keys)]).astype(np.int64)
    lengths = sorted({len(k) - k.index(b"/") for k in keys})
    parts = [
        np.array([digests[k] for k in keys], np.uint64).tobytes(), ends.tobytes(),
        bytes(verdicts[k] for k in keys), b"".join(keys), json.dumps(lengths).encode(),
    ]
    name = f"url-rules-{uuid.uuid4().hex}.bin"  # Spark knows a dealt file by its name alone
    with open(os.path.join(folder, name), "wb") as out:
        out.write(np.array([len(p) for p in parts] + [0] * (_MAGIC - len(parts)), np.int64).tobytes())
        for part in parts:
            out.write(part)
    return os.path.join(folder, name)


class DigestArray:
    """A digest file, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        sizes = whole[: 8 * _MAGIC].view(np.int64).tolist()
        cuts = np.cumsum([8 * _MAGIC, *sizes[:5]])
        part = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.digests, self.ends = part[0].view(np.uint64), part[1].view(np.int64)
        self.blocked, self.keys = part[2], part[3]
        self.lengths = json.loads(part[4].tobytes())

    def key(self, i: int) -> bytes:
        return self.keys[self.ends[i] : self.ends[i + 1]].tobytes()

    def found(self, asked: list[bytes]) -> np.ndarray:
        """Index of each asked key, or -1: binary search of all at once, then full keys."""
        digests = np.fromiter(map(xxhash.xxh3_64_intdigest, asked), np.uint64, len(asked))
        place = np.searchsorted(self.digests, digests)
        out = np.full(len(asked), -1, np.int64)
        hits = np.flatnonzero(place < len(self.digests))
        hits = hits[self.digests[place[hits]] == digests[hits]]
        for i in hits.tolist():
            at = int(place[i])
            while at < len(self.digests) and self.digests[at] == digests[i]:
                if self.key(at) == asked[i]:
                    out[i] = at
                    break
                at += 1
        return out


def candidates(host: bytes, path: bytes, lengths: list[int]) -> Iterator[bytes]:
    """Keys of all rules that would fit, the longest first; of equal lengths, the longer host."""
    suffixes = [host]
    for i, byte in enumerate(host):
        if byte == 0x2E:
            suffixes.append(host[i + 1 :])
    beginnings = [path[:n] for n in lengths if n <= len(path)]
    both = [(len(s) + len(p), len(s), s + p) for s in suffixes if s for p in beginnings]
    for _, _, key in sorted(both, reverse=True):
        yield key


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path of a URL; both empty if it is null or has no ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    none = F.lit("")
    known = url.isNotNull() & url.contains("://")
    return (
        F.when(known, ascii_lower(F.regexp_extract(url, whole, 1))).otherwise(none),
        F.when(known, F.regexp_extract(url, whole, 2)).otherwise(none),
    )


def _probe(name: str):
    @F.arrow_udf("struct<rule: string, block: boolean>")
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rules = DigestArray(SparkFiles.get(name))
        for hosts, paths in batches:
            owner, asked = [], []
            for i, (host, path) in enumerate(zip(hosts.cast(pa.binary()), paths.cast(pa.binary()), strict=True)):
                for key in candidates(host.as_py(), path.as_py(), rules.lengths):
                    owner.append(i), asked.append(key)
            rule, block = [None] * len(hosts), [None] * len(hosts)
            for i, at in zip(owner, rules.found(asked).tolist(), strict=True):
                if at >= 0 and rule[i] is None:
                    rule[i], block[i] = rules.key(at).decode(), bool(rules.blocked[at])
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(block, pa.bool_())], names=["rule", "block"])

    return probe


def filtered_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], column: str = "url", default: str = "allow") -> DataFrame:
    """All pages with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules`` are pairs of ``host/path`` and allow or block. A URL that no rule fits
    gets the ``default``. Other columns stay; those of the four names are replaced.
    """
    spark: SparkSession = pages.sparkSession
    path = digest_file(rules, tempfile.mkdtemp(prefix="url-rules-"))
    spark.sparkContext.addFile(path)
    host, rest = parts_of(F.col(column))
    judged = pages.withColumns({"host": host, "path": rest}).withColumn("__hit", _probe(os.path.basename(path))("host", "path"))
    verdict = F.when(F.col("__hit.block").isNull(), default).when(F.col("__hit.block"), "block").otherwise("allow")
    return judged.withColumns({"rule": F.col("__hit.rule"), "verdict": verdict}).drop("__hit")
