"""Operator 2 keeps few pixel arrays on disk."""

from pathlib import Path

from tidemark.llm import common, media


def test_pixel_arrays_are_on_disk_in_parts(odd, monkeypatch):
    """Arrays are written in runs over the media, and those of a run are gone before the next; media stay."""
    root = Path(common.shared_dir(odd.sparkSession).removeprefix("file:"))
    before, seen = set(root.glob("*")), []

    def watched(df, tag, **options):
        seen.append((tag, sum(p.name.startswith("pixels-") for p in set(root.glob("*")) - before)))
        return common.settle(df, tag, **options)

    monkeypatch.setattr(media, "settle", watched)
    cores = odd.sparkSession.sparkContext.defaultParallelism
    docs = odd.crossJoin(odd.sparkSession.range(cores).select()).repartition(cores * media.WAVES)
    rows = media.media_round_trip(docs).collect()
    assert [n for tag, n in seen if tag == "pixels"] == [0] * media.WAVES
    assert sorted(p.name.split("-")[0] for p in set(root.glob("*")) - before) == ["digests"] * media.WAVES + ["media"]
    seen.clear()
    few = media.media_round_trip(docs.coalesce(1)).collect()
    assert [tag for tag, _ in seen] == ["media", "pixels", "digests"]  # a run of its own would leave cores without work
    assert sorted(map(str, rows)) == sorted(map(str, few))
