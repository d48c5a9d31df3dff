"""Hashes of files that do not fit into a value, an odd name and an empty file."""

import hashlib
import resource

from tessera.sources import files


def test_hashes_of_files_of_any_size(spark, tmp_path):
    size = (5 << 29) + 12_345  # beyond the 2 GB that a binary value holds
    with open(tmp_path / "large.bin", "wb") as f:
        f.write(b"start")
        f.truncate(size)
    (tmp_path / "odd name é%20.txt").write_bytes(b"odd")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "nested").write_bytes(b"nested")
    (tmp_path / "sub" / "empty").write_bytes(b"")  # not listed
    want = hashlib.sha256(b"start")
    zeros = bytes(1 << 20)
    for _ in range((size - 5) >> 20):
        want.update(zeros)
    want.update(bytes((size - 5) & ((1 << 20) - 1)))
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert set(got) == {"large.bin", "odd name é%20.txt", "nested"} and got["large.bin"] == want.hexdigest() and got["nested"] == hashlib.sha256(b"nested").hexdigest()
    assert hashlib.sha256(b"odd").hexdigest() in got.values()
    plan = files.file_hashes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 4_000_000


def test_a_task_holds_a_piece_of_a_file(tmp_path):
    """The loop of a task, without Spark: peak memory stays far below the file."""
    import tracemalloc

    path = tmp_path / "x"
    with open(path, "wb") as f:
        f.truncate(1 << 28)
    tracemalloc.start()
    digest = hashlib.sha256()
    with files.opened(f"file:{path}") as stream:
        while piece := stream.read(files.PIECE):
            digest.update(piece)
    assert tracemalloc.get_traced_memory()[1] < 8 * files.PIECE
    tracemalloc.stop()
