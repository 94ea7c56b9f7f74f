"""URL rules in a sorted array of 64-bit digests: memory-mapped, probed by binary search, confirmed on the strings."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, put, slices

#: (host, path, verdict)
Rule = tuple[str, str, str]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url):
    """Columns of a url: the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
    the path from there up to ``?``, ``#`` or the end. Both are empty for null or where ``://`` is missing."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


class DigestArray:
    """Strings sorted by a 64-bit digest, in one block of bytes: their number, digests, ends, numbers among those given,
    and the strings. Read from a memory-mapped file, the workers of an executor share its pages, and the strings are
    read only where a digest matches."""

    def __init__(self, block: np.ndarray, digest=xxhash.xxh64_intdigest):
        self.digest = digest
        self.n = int(block[:8].view("<u8")[0])
        at = np.cumsum([8, 8 * self.n, 8 * self.n + 8, 8 * self.n]).tolist()
        self.sorted, self.ends, self.order = block[at[0] : at[1]].view("<u8"), block[at[1] : at[2]].view("<i8"), block[at[2] : at[3]].view("<i8")
        self.strings = block[at[3] :]

    @staticmethod
    def build(keys: list[bytes], digest=xxhash.xxh64_intdigest) -> bytes:
        found = np.array([digest(k) for k in keys], np.uint64)
        order = np.argsort(found, kind="stable").astype("<i8")
        ends = np.cumsum([0, *[len(keys[i]) for i in order]]).astype("<i8")
        return b"".join([np.array([len(keys)], "<u8").tobytes(), found[order].astype("<u8").tobytes(), ends.tobytes(), order.tobytes(), *[keys[i] for i in order]])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key among those given, -1 if it is not one of them."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not keys:
            return out
        wanted = np.array([self.digest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.sorted, wanted)
        todo = np.flatnonzero((at < self.n) & (self.sorted[np.minimum(at, self.n - 1)] == wanted))
        for i in todo.tolist():
            j = int(at[i])
            while j < self.n and self.sorted[j] == wanted[i]:  # equal digests of different strings stand together
                if self.strings[self.ends[j] : self.ends[j + 1]].tobytes() == keys[i]:
                    out[i] = self.order[j]
                    break
                j += 1
        return out


@lru_cache(maxsize=4)
def _mapped(name: str) -> tuple[DigestArray, list[str], np.ndarray, list[int], list[str]]:
    """The array of a file that Spark has brought to this executor; the verdicts by name, the verdict and the length of
    the host of each rule, and the lengths of the rules' paths."""
    block = np.memmap(SparkFiles.get(name), np.uint8, "r")
    head = int(block[:8].view("<u8")[0])
    more = json.loads(block[8 : 8 + head].tobytes())
    at = 8 + head
    n = more["rules"]
    cuts, verdict = block[at : at + 8 * n].view("<i8"), block[at + 8 * n : at + 16 * n].view("<i8")
    return DigestArray(block[at + 16 * n :]), more["verdicts"], verdict, cuts, more["lengths"]


def _spread(spark, rules: dict[tuple[str, str], str]) -> str:
    """Writes the rules to the shared folder once, has Spark bring the file to each executor, and gives its name."""
    names = list(rules)
    verdicts = sorted(set(rules.values()))
    more = json.dumps({"rules": len(names), "verdicts": verdicts, "lengths": sorted({len(p.encode()) for _, p in names})}).encode()
    more += b" " * (-len(more) % 8)
    cuts = np.array([len(h.encode()) for h, _ in names], "<i8")
    verdict = np.array([verdicts.index(rules[k]) for k in names], "<i8")
    data = b"".join([np.array([len(more)], "<u8").tobytes(), more, cuts.tobytes(), verdict.tobytes(), DigestArray.build([f"{h}{p}".encode() for h, p in names])])
    name = f"rules-{xxhash.xxh3_128_hexdigest(data)}"
    spark.sparkContext.addFile(put(spark, name, data))
    return name


def host_suffixes(host: bytes, longest: int) -> list[bytes]:
    """The host and what follows each of its dots, but nothing longer than ``longest`` bytes."""
    tail = host[-longest - 1 :] if longest else b""
    out = [host] if 0 < len(host) <= longest else []
    at = tail.find(b".")
    while at >= 0:
        out.append(tail[at + 1 :])
        at = tail.find(b".", at + 1)
    return [x for x in out if x]


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row. A rule fits its host and all subdomains if the path
    starts with the rule's; the longest fitting rule decides, of equally long ones the one with the longer host;
    without one ``rule`` is null and the verdict ``default``. Rules that repeat a host and path: the last one counts.

    Rules are given by the caller and become one file, which Spark brings to each executor and its workers map. The
    suffixes of the host at a dot, as far as they are no longer than the longest host of a rule, with each prefix of
    the path as long as some rule's path, are looked up at once, so the keys of a url are bounded by the rules, not by
    the url. A null url has empty host and path and fits no rule, nor does any other with an empty host. Repeated rows are judged
    alike, one by one; an empty table, or no rules, gives a result without rules; further columns don't matter.
    """
    own = {(h, p): v for h, p, v in rules}
    name = _spread(pages.sparkSession, own)
    longest = max((len(h.encode()) for h, _ in own), default=0)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        array, names, verdict_of, cuts, lengths = _mapped(name)
        for b in slices(batches, 4 << 20, "host"):
            wanted, owner, size, cut = [], [], [], []
            for i, (host, path) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                path = path.encode()
                for h in host_suffixes(host.encode(), longest):
                    for n in lengths:
                        if n <= len(path):
                            wanted.append(h + path[:n])
                            owner.append(i)
                            size.append(len(h) + n)
                            cut.append(len(h))
            best: dict[int, tuple] = {}
            found = array.find(wanted)
            for c in np.flatnonzero(found >= 0).tolist():
                k = int(found[c])
                if cuts[k] == cut[c]:
                    best[owner[c]] = max(best.get(owner[c], (-1,)), (size[c], cut[c], k, wanted[c]))
            rule = [best[i][3].decode() if i in best else None for i in range(b.num_rows)]
            verdict = [names[verdict_of[best[i][2]]] if i in best else default for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    src = pick(pages, page_id=id_col, url=url_col)
    host, path = host_path(F.col("url"))
    src = src.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return src.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


#: The rules the query is asked to apply.
RULES: list[Rule] = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

URL_SQL = r"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM p),
r(rh, rp, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
      FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
