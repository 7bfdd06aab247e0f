"""What the driver's process keeps."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from lumenql.llm.shared import saved


def _resident_mb(pid: int) -> float:
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_saved_gives_freed_native_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    if not Path(f"/proc/{pid}/smaps_rollup").exists():
        pytest.skip("resident memory can't be read here")
    saved(spark.range(10), "zwarm").count()
    jvm.System.gc()
    before = _resident_mb(pid)
    # blocks outside the heap, as compilers use; the few that stay keep malloc from returning the others by itself
    made = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    grown = _resident_mb(pid) - before
    assert grown > 100
    for i, d in enumerate(made):
        if i % 50 != 49:
            d.end()
    assert _resident_mb(pid) - before > 0.6 * grown
    saved(spark.range(10), "zmemory").count()
    left = _resident_mb(pid) - before
    for d in made[49::50]:
        d.end()
    assert left < 0.5 * grown, (left, grown)
