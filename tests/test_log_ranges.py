"""A task reads many chunks of a log file."""

from corpusloom.sources import logs


def test_one_task_for_many_chunks(tmp_path):
    text = "é[x]\nß日本\n" * 300
    (tmp_path / "a.log").write_text(text, "utf-8")
    reader = logs.LogReader({"path": str(tmp_path), "chunkBytes": "7"})
    ranges = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(ranges) == 1
    chunks = [c for r in ranges for c in reader.read(r)]
    size = len(text.encode())
    assert [seq for _, seq, _ in chunks] == list(range(0, size, 7)) and "".join(c for *_, c in chunks) == text
    # The same chunks as from a range for each.
    assert chunks == [c for at in range(0, size, 7) for c in reader.read(logs.Range("a.log", at, min(at + 7, size)))]
