"""Published relations and the names of states and outcomes."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType


def _struct(text: str) -> StructType:
    kinds = {"s": StringType(), "l": LongType(), "i": IntegerType(), "b": BinaryType(), "t": BooleanType()}
    return StructType([StructField(n, kinds[k]) for n, k in (part.split(":") for part in text.split())])


#: The inventory: one row for each file and folder of a scan. Files have null folder columns and the reverse.
INVENTORY = _struct(
    "record_type:s rel_path:s size:l mtime:l mode:i uid:i gid:i flat_file_count:l flat_logical_size_bytes:l "
    "hash_algorithm:s content_hash:s hash_block_size:l hash_block_count:l block_hash_algorithm:s block_hashes:s "
    "scan_run_id:s run_started_at_utc:s run_started_unix_ns:l source_root:s run_settings:s"
)
#: A compact scan row. Hashes are 64-bit patterns in signed longs; files print them unsigned.
SNAPSHOT = _struct(
    "folder_hash:l file_hash:l rel_path:s size:l mtime:l mode:l uid:l gid:l data_hash:l hash_ts:l scan_side:s"
)
#: What a diff says of a path.
DIFF = _struct(
    "rel_path:s kind:s source_size:l target_size:l source_mtime:l target_mtime:l bytes_planned:l compare_mode:s"
)
#: What a diff says of a folder, in the order of the report's columns.
FOLDER_DIFF = _struct(
    "rel_path:s error:s source_scan_started_unix_ns:l source_scan_finished_unix_ns:l target_scan_started_unix_ns:l "
    "target_scan_finished_unix_ns:l result_sent_unix_ns:l result_received_unix_ns:l source_file_count:l target_file_count:l "
    "source_folder_count:l target_folder_count:l files_same:l files_changed:l files_new:l files_target_only:l files_failed:l "
    "source_logical_size_bytes:l target_logical_size_bytes:l same_logical_size_bytes:l changed_logical_size_bytes:l "
    "new_logical_size_bytes:l target_only_logical_size_bytes:l bytes_planned:l status:i"
)

MODES = ("transfer", "scan", "dry-run")
ROLES = ("sender", "receiver")
FILE_STATES = ("pending", "checking", "skipped", "reading", "transferring", "receiving", "writing", "failed", "done")
FOLDER_STATES = ("pending", "reading", "transferring", "awaiting_ack", "receiving", "writing", "done")
DIFF_KINDS = ("skip", "new", "changed", "target_only", "failed")
COMPARE_MODES = ("size", "time", "content", "metadata")
#: Files up to this size are small.
SMALL_FILE_THRESHOLD = 128 * 1024
LARGE_CHUNK_BYTES = 1024 * 1024
