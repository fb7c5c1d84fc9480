import pytest

from tidelog.errors import InvalidOptions
from tidelog.options import MIB, Options, from_args, parse_size, parse_sync


def test_defaults_and_demo_are_valid():
    assert Options().validate().level_limit(2) == 10_000 * MIB
    assert Options.demo().validate().l0_trigger == 4


@pytest.mark.parametrize(
    "bad",
    [
        {"memtable_bytes": 100}, {"memtable_bytes": 257 * MIB}, {"max_frozen": 0}, {"max_frozen": 25}, {"flush_retries": 6}, {"sync": 0}, {"sync": "often"},
        {"segment_bytes": 1000}, {"l0_trigger": 1}, {"l0_trigger": 51}, {"level_multiplier": 1}, {"level_multiplier": 21}, {"l0_stop": 10}, {"level_base_bytes": 99 * MIB},
        {"stall_ms": 2049}, {"wal_recovery": "none"},
    ],
)
def test_ranges(bad):
    with pytest.raises(InvalidOptions):
        Options(**bad).validate()


def test_sizes():
    assert [parse_size(s) for s in ("4096", "8MiB", "16k", "2Gb", "3B", "0kib")] == [4096, 8 * MIB, 16384, 2 << 30, 3, 0]
    for bad in ("", "MiB", "8 MiB", "-1", "1.5k", "9tb", "20000000000g"):
        with pytest.raises(InvalidOptions):
            parse_size(bad)


def test_sync_and_command_line():
    assert [parse_sync(s) for s in ("always", "none", "every:20")] == ["always", "none", 20]
    for bad in ("every", "every:", "every:x", "Always"):
        with pytest.raises(InvalidOptions):
            parse_sync(bad)
    folder, options = from_args(["--dir", "x", "--demo", "--l0-compaction-trigger", "7", "--sync", "every:5", "--max-sst-size", "200kib"])
    assert folder == "x" and options.l0_trigger == 7 and options.sync == 5 and options.segment_bytes == 200 * 1024 and options.level_multiplier == 4
