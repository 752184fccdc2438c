"""Watermarks, state machines, balances and names: decisions as columns or as plain functions."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions.u64 import umod


def watermarks(ram_percent: Column, disk_percent: Column) -> dict[str, Column]:
    """What memory and disk pressure ask for. Values out of 0 to 100 raise an error."""
    for value in (ram_percent, disk_percent):
        bad = (value < 0) | (value > 100)
        ram_percent = F.when(bad, F.raise_error(F.lit("percentages lie between 0 and 100")).cast("double")).otherwise(ram_percent)
    return {
        "soft_throttle": ram_percent >= 70,
        "spill_to_disk": ram_percent > 85,
        "hard_stop": (ram_percent > 95) | (disk_percent > 95),
        "prefetch_to_ram": disk_percent < 20,
        "pause_reader": disk_percent > 80,
    }


def throttles(ram_percent: Column) -> dict[str, Column]:
    """The jobs' own bounds, which differ from the watermarks: spilling starts at 85 itself."""
    return {
        "reader_pauses": ram_percent >= 85,
        "reader_resumes": ram_percent <= 70,
        "cache_spills": ram_percent >= 85,
        "cache_drains": ram_percent <= 70,
        "receiver_refills": ram_percent < 50,
    }


#: From which state a file may go to which, for each role.
FILE_MOVES = {
    "sender": {
        "pending": ("checking", "reading"),
        "checking": ("skipped", "reading"),
        "skipped": ("done",),
        "reading": ("transferring", "done", "failed"),
        "transferring": ("done", "failed"),
        "failed": ("reading",),
    },
    "receiver": {
        "pending": ("checking", "receiving"),
        "checking": ("receiving", "done"),
        "receiving": ("writing", "failed"),
        "writing": ("done", "failed"),
        "failed": ("receiving",),
    },
}
#: The same for folders.
FOLDER_MOVES = {
    "sender": {
        "pending": ("reading",),
        "reading": ("transferring", "awaiting_ack", "done"),
        "transferring": ("awaiting_ack",),
        "awaiting_ack": ("done",),
    },
    "receiver": {"pending": ("receiving",), "receiving": ("writing", "done"), "writing": ("done",)},
}


def moves(spark: SparkSession, table: dict = FILE_MOVES) -> DataFrame:
    """(role, from_state, to_state): all allowed moves between different states."""
    rows = [(r, a, b) for r, by in table.items() for a, to in by.items() for b in to]
    return spark.createDataFrame(rows, "role string, from_state string, to_state string")


def allowed(role: Column, before: Column, after: Column, table: dict = FILE_MOVES) -> Column:
    """Whether a move is allowed; to stay always is."""
    keys = [f"{r}:{a}:{b}" for r, by in table.items() for a, to in by.items() for b in to]
    return (before == after) | F.concat_ws(":", role, before, after).isin(keys)


def checked_move(role: str, before: str, after: str, table: dict = FILE_MOVES) -> str:
    if before != after and after not in table[role].get(before, ()):
        raise ValueError(f"a {role} may not go from {before} to {after}")
    return after


def dispatch_connection(file_id: Column, connections: int) -> Column:
    """The connection that a file goes by: its unsigned id modulo their number; 0 if there is none."""
    return umod(file_id, connections) if connections else F.lit(0).cast("long")


def cache_path(entry: Column) -> Column:
    """aa/bb/aabb...: sixteen hexadecimal digits below two folders of two."""
    digits = F.lower(F.lpad(F.hex(entry), 16, "0"))
    return F.concat_ws("/", F.substring(digits, 1, 2), F.substring(digits, 3, 2), digits)


def csv_quoted(text: Column, quote_empty: bool = False) -> Column:
    """Quotes where a comma, quote or line end asks for them; for inventories, around the empty text as well."""
    asks = text.rlike('[,"\r\n]')
    return F.when(asks | (text == "") if quote_empty else asks, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def text_quoted(text: Column) -> Column:
    """Between quotes, with a backslash before quotes and backslashes."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def sql_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


@dataclass
class Bucket:
    """Progress of the small or the large files."""

    total: int
    done: int
    per_second: float
    workers: int
    max_workers: int
    total_bytes: int = 0
    done_bytes: int = 0
    bytes_per_second: float = 0.0


@dataclass
class Balance:
    small_workers: int
    large_workers: int
    borrow_percent: int
    small_eta: float
    large_eta: float


def _eta(left: float, rate: float) -> float:
    return 0.0 if left <= 0 else left / rate if rate > 0 else math.inf


def balance(small: Bucket, large: Bucket) -> Balance:
    """Give workers to the side that ends later: small files by number, large ones by bytes.

    Nothing large left: one large worker stays, and all of the large readers' time is
    lent to small files. Otherwise the later side grows by a quarter at most, the
    other gives as many, and large readers lend by how much later the small files end.
    """
    eta_s = _eta(small.total - small.done, small.per_second)
    eta_l = _eta(large.total_bytes - large.done_bytes, large.bytes_per_second)
    if eta_l == 0:
        grown = small.workers + max(1, large.workers - 1)
        return Balance(min(small.max_workers, max(small.workers + 1, grown)), 1, 100, eta_s, eta_l)
    if eta_s == eta_l:
        return Balance(small.workers, large.workers, 0, eta_s, eta_l)
    later, other = (small, large) if eta_s > eta_l else (large, small)
    ratio = 1 - min(eta_s, eta_l) / max(eta_s, eta_l) if math.isfinite(max(eta_s, eta_l)) else 1.0
    moved = max(1, round(later.workers * 0.25 * ratio))
    more, fewer = min(later.max_workers, later.workers + moved), max(1, other.workers - moved)
    if later is small:
        return Balance(more, fewer, max(1, round(100 * ratio)), eta_s, eta_l)
    return Balance(fewer, more, 0, eta_s, eta_l)


def scanner_split(small: int, large: int, floor: int, borrow_percent: int) -> tuple[int, int]:
    """(small, large) scanners: while readers are lent, large scanners above the floor scan small files too."""
    moved = max(0, large - floor) if borrow_percent > 0 else 0
    return small + moved, large - moved


def _octets(text: str) -> list[int] | None:
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        return None
    return [int(p) for p in parts]


def expand_servers(expression: str, most: int = 4096) -> list[str]:
    """Servers of a list with commas, in which a-b is a range of IPv4 addresses; b can be the last number alone."""
    out: list[str] = []
    for token in (t.strip() for t in expression.split(",")):
        if not token:
            continue
        first, dash, last = (t.strip() for t in token.partition("-"))
        low = _octets(first) if dash else None
        high = _octets(last) if low else None
        if low and high is None and last.isdigit() and int(last) <= 255:
            high = [*low[:3], int(last)]
        if low is None or high is None:
            out.append(token)
            continue
        a, b = (int.from_bytes(bytes(x), "big") for x in (low, high))
        if b < a:
            raise ValueError(f"server range must be ascending: {token}")
        if b - a + 1 > most:
            raise ValueError(f"server range is too long: {token}")
        out += [".".join(map(str, n.to_bytes(4, "big"))) for n in range(a, b + 1)]
    return out or [expression]


def is_nfs_url(url: str) -> bool:
    return url.startswith("nfs://")


def expand_nfs_url(url: str) -> list[str]:
    """The url once for each of its servers."""
    if not is_nfs_url(url):
        return [url]
    servers, slash, rest = url.removeprefix("nfs://").partition("/")
    return [f"nfs://{s}{slash}{rest}" for s in expand_servers(servers)]


def endpoint_of(worker: int, endpoints: list[str]) -> str:
    """Sticky choice: a worker keeps to one endpoint."""
    return endpoints[worker % len(endpoints)]


def require_root_for_owner_change(path: str, uid: int, gid: int, new_uid: int, new_gid: int) -> None:
    if (uid, gid) != (new_uid, new_gid) and os.geteuid() != 0:
        raise PermissionError(f"only root can change the owner of {path}")
