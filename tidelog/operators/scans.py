"""Range scans as a session: pinned, checked, paged and counted."""

from __future__ import annotations

import base64
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import reads


class ScanError(Exception):
    """Carries the status of a scan that cannot go on."""


def bounds(request: dict) -> tuple[str, str, bool, bool]:
    """(low, high, after_low, before_high) of a request with base64 keys; each side has exactly one of its two forms."""
    sides = []
    for plain, exclusive in (("start", "excl_start"), ("end", "excl_end")):
        if (plain in request) == (exclusive in request):
            raise ScanError("invalid_arguments")
        name = plain if plain in request else exclusive
        sides.append((base64.b64decode(request[name]).decode("utf-8", "replace"), name == exclusive))
    return sides[0][0], sides[1][0], sides[0][1], sides[1][1]


@dataclass
class RangeScan:
    """A scan of one collection. `rows` is its filtered state, a written table if create() was given a path; pages follow one another by key."""

    rows: DataFrame
    key_only: bool
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    after: tuple[int, str] | None = None
    pages: int = 0
    cancelled: bool = False

    def proceed(self, items: int) -> list:
        """The next page: a bounded top-k over what is left."""
        if self.cancelled:
            raise ScanError("range_scan_cancelled")
        found = reads.page(self.rows, items, self.after).collect()
        if found:
            self.after = (found[-1]["cid"], found[-1]["key"])
        self.pages += 1
        return found

    def cancel(self) -> None:
        self.cancelled = True


def create(log: DataFrame, cid: int, request: dict, as_of: int, *, newest_uuid: int | None = None, persisted: int | None = None, pin_to: str | None = None) -> RangeScan:
    """Opens a scan from a request: range or sampling, key_only, snapshot_requirements; raises ScanError if it cannot be had.

    With pin_to, a path that all executors share, the scan's rows are written there once, ranged and sorted by key: pages
    then read the row groups around their start instead of making the state anew, and writes to the log do not move the scan.
    """
    snapshot = request.get("snapshot_requirements")
    if snapshot:
        if newest_uuid is not None and int(snapshot["vb_uuid"]) != newest_uuid:
            raise ScanError("vbuuid_not_equal")
        if persisted is not None and int(snapshot["seqno"]) > persisted:
            raise ScanError("temporary_failure")
        if snapshot.get("seqno_exists") and log.where(F.col("seqno") == int(snapshot["seqno"])).isEmpty():
            raise ScanError("not_stored")
    docs = reads.current(log.where(F.col("cid") == cid), as_of)
    if ("range" in request) == ("sampling" in request):
        raise ScanError("invalid_arguments")
    if "range" in request:
        low, high, after_low, before_high = bounds(request["range"])
        docs = reads.key_range(docs, low, high, after_low=after_low, before_high=before_high)
    else:
        wanted, total = int(request["sampling"]["samples"]), docs.count()
        if total > wanted:
            docs = reads.sample(docs, wanted / total, int(request["sampling"].get("seed", 0)))
    key_only = bool(request.get("key_only"))
    if key_only:
        docs = docs.select("cid", "key")
    if pin_to is not None:
        docs.repartitionByRange("cid", "key").sortWithinPartitions("cid", "key").write.parquet(pin_to)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(pin_to)
    if docs.isEmpty():
        raise ScanError("no_such_key")
    return RangeScan(docs, key_only)
