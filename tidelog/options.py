"""Settings of a store, their ranges, and their forms on a command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

from .errors import InvalidOptions
from .schema import MAX_KEY_BYTES, MAX_VALUE_BYTES, RECORD_HEADER_BYTES

MIB = 1 << 20
_RECORD = MAX_KEY_BYTES + MAX_VALUE_BYTES + RECORD_HEADER_BYTES
_UNITS = {"": 1, "b": 1} | {u + s: 1024 ** (p + 1) for p, u in enumerate("kmg") for s in ("", "b", "ib")}


@dataclass(frozen=True)
class Options:
    # The defaults of the data model.
    sync: str | int = "always"  # "always", "none", or milliseconds between syncs
    wal_recovery: str = "point_in_time"  # or "absolute_consistency"
    memtable_bytes: int = 8 * MIB
    flush_retries: int = 5
    max_frozen: int = 4
    segment_bytes: int = 100 * MIB
    l0_trigger: int = 10
    level_base_bytes: int = 1000 * MIB
    level_multiplier: int = 10
    l0_stop: int = 30
    stall_ms: int = 512
    keep_tombstones: bool = False  # at the bottom level too, so that lookups tell deleted keys from keys never written

    def validate(self) -> "Options":
        """Itself, or InvalidOptions with the first range that is left."""
        block = 8 * 1024 + _RECORD
        rules = [
            ("memtable_bytes", _RECORD <= self.memtable_bytes <= 256 * MIB),
            ("max_frozen", 1 <= self.max_frozen <= 24),
            ("flush_retries", 0 <= self.flush_retries <= 5),
            ("sync", self.sync in ("always", "none") or isinstance(self.sync, int) and self.sync > 0),
            ("segment_bytes", self.segment_bytes >= block),
            ("l0_trigger", 2 <= self.l0_trigger <= 50),
            ("level_multiplier", 2 <= self.level_multiplier <= 20),
            ("l0_stop", self.l0_stop > self.l0_trigger),
            ("level_base_bytes", self.level_base_bytes >= self.segment_bytes),
            ("stall_ms", 0 <= self.stall_ms <= 2048),
            ("keep_tombstones", isinstance(self.keep_tombstones, bool)),
            ("wal_recovery", self.wal_recovery in ("point_in_time", "absolute_consistency")),
        ]
        for name, ok in rules:
            if not ok:
                raise InvalidOptions(f"{name} = {getattr(self, name)!r} is out of range")
        return self

    @staticmethod
    def demo() -> "Options":
        # The small preset.
        kib = 1024
        return Options(memtable_bytes=256 * kib, segment_bytes=256 * kib, level_base_bytes=512 * kib, level_multiplier=4, l0_trigger=4)

    def level_limit(self, level: int) -> int:
        """Bytes that a level from 1 on may hold."""
        return self.level_base_bytes * self.level_multiplier ** (level - 1)


def parse_size(text: str) -> int:
    """``4096``, ``8MiB``, ``16k``: units are powers of 1024, in any case; below 2**64."""
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    unit = text[len(digits) :].lower()
    if not digits or unit not in _UNITS:
        raise InvalidOptions(f"not a size: {text!r}")
    size = int(digits) * _UNITS[unit]
    if size >= 1 << 64:
        raise InvalidOptions(f"size too large: {text!r}")
    return size


def parse_sync(text: str) -> str | int:
    """``always``, ``none``, or ``every:<milliseconds>``."""
    if text in ("always", "none"):
        return text
    head, _, ms = text.partition(":")
    if head == "every" and ms.isascii() and ms.isdigit():
        return int(ms)
    raise InvalidOptions(f"expected always, none or every:<ms>, not {text!r}")


_FLAGS = {
    "--sync": ("sync", parse_sync),
    "--wal-recovery-mode": ("wal_recovery", lambda s: s.replace("-", "_")),
    "--memtable-size": ("memtable_bytes", parse_size),
    "--max-frozen-memtables": ("max_frozen", int),
    "--max-flush-retries": ("flush_retries", int),
    "--max-sst-size": ("segment_bytes", parse_size),
    "--l0-compaction-trigger": ("l0_trigger", int),
    "--max-bytes-for-level-base": ("level_base_bytes", parse_size),
    "--level-multiplier": ("level_multiplier", int),
}


def from_args(args: list[str]) -> tuple[str, Options]:
    """Folder and options of a command line: flags override the defaults (or --demo) only where given."""
    parser = argparse.ArgumentParser(prog="tidelog")
    parser.add_argument("--dir", default="data")
    parser.add_argument("--demo", action="store_true")
    for flag, (name, kind) in _FLAGS.items():
        parser.add_argument(flag, dest=name, type=kind)
    got = vars(parser.parse_args(args))
    base = Options.demo() if got["demo"] else Options()
    given = {name: got[name] for name, _ in _FLAGS.values() if got[name] is not None}
    return got["dir"], replace(base, **given).validate()
