"""Framing of capture files: blocks of pcapng and records of classic pcap, in pieces of bounded size.

A file is read once from its begin, since each block tells only where the next one starts. What is
found by that walk are positions; lengths, times and interfaces of all packets of a piece are then
decoded together from the bytes. Memory follows CHUNK and the largest block, not the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

#: Block types, their least lengths, the largest length, byte-order marks.
SECTION, INTERFACE, PACKET, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
LEAST = {SECTION: 28, INTERFACE: 20, PACKET: 32, SIMPLE: 16, ENHANCED: 32}
LARGEST = 64 * 1024 * 1024
LITTLE_MARK, BIG_MARK = b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"
#: Magic numbers of classic captures: (big-endian, nanoseconds in a tick).
CLASSIC = {
    b"\xd4\xc3\xb2\xa1": (False, 1000), b"\xa1\xb2\xc3\xd4": (True, 1000),
    b"\x4d\x3c\xb2\xa1": (False, 1), b"\xa1\xb2\x3c\x4d": (True, 1),
}
ETHERNET = 1
CHUNK = 8 << 20
NANOS = 1_000_000_000

_TWO = {False: struct.Struct("<II"), True: struct.Struct(">II")}
_ONE = {False: struct.Struct("<I"), True: struct.Struct(">I")}


class InvalidCapture(RuntimeError):
    """A file that is no well-formed capture."""

    def __init__(self, message: str) -> None:
        super().__init__(f"INVALID_CAPTURE: {message}")


@dataclass(frozen=True)
class Clock:
    """How ticks of an interface count: of 10**-digits or 2**-digits seconds, from an offset in seconds."""

    digits: int = 6
    binary: bool = False
    offset: int = 0

    def nanos(self, ticks: np.ndarray) -> np.ndarray:
        """Nanoseconds since the epoch of uint64 ticks, rounded down."""
        base = 2 if self.binary else 10
        if not self.binary and self.digits <= 9:
            found = ticks.astype(np.int64) * base ** (9 - self.digits)
        else:  # finer than nanoseconds, or binary: beyond 64 bits on the way
            found = np.array([int(t) * NANOS // base**self.digits for t in ticks], dtype=np.int64)
        return found + self.offset * NANOS


@dataclass
class Frames:
    """The packets of a piece: ``data[start:end]`` each. ``nanos`` only counts where ``timed``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    original: np.ndarray
    nanos: np.ndarray
    timed: np.ndarray
    section: np.ndarray
    interface: np.ndarray
    linktype: np.ndarray
    first: int  # number of the first packet in its file, from 1
    #: (packets before it, big-endian, bytes) of each block that is no packet, section or interface
    others: list[tuple[int, bool, bytes]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.start)


def _options(block: bytes, at: int, end: int, big: bool) -> Iterator[tuple[int, bytes]]:
    kind = struct.Struct(">HH" if big else "<HH")
    while at + 4 <= end:
        code, size = kind.unpack_from(block, at)
        if code == 0 or at + 4 + size > end:
            return
        yield code, block[at + 4 : at + 4 + size]
        at += 4 + size + -size % 4


def _interface(block: bytes, big: bool) -> tuple[int, Clock]:
    """(link type, clock) of an interface description."""
    linktype = int.from_bytes(block[8:10], "big" if big else "little")
    found = {code: value for code, value in _options(block, 16, len(block) - 4, big)}
    resolution = found[9][0] if len(found.get(9, b"")) == 1 else 6
    offset = int.from_bytes(found[14], "big" if big else "little", signed=True) if len(found.get(14, b"")) == 8 else 0
    return linktype, Clock(resolution & 0x7F, resolution >= 0x80, offset)


def _numbers(data: np.ndarray, at: np.ndarray, big: np.ndarray) -> np.ndarray:
    """The 32-bit numbers at the given places, in each one's byte order."""
    four = data[at[:, None] + np.arange(4)]
    return np.where(big, four.view(">u4")[:, 0], four.view("<u4")[:, 0]).astype(np.int64)


def _fault(kind: int, length: int, left: int) -> str | None:
    """What is wrong with a block's length, if anything; ``left``: bytes of the file from the block on."""
    if length < LEAST.get(kind, 12):
        return "pcapng block is too short"
    if length % 4:
        return "pcapng block length is not aligned"
    if length > LARGEST:
        return "pcapng block exceeds the 64 MiB safety limit"
    return "pcapng block length exceeds remaining file size" if length > left else None


def _walk(stream: BinaryIO, size: int) -> Iterator[tuple[bytes, list[tuple[int, bool, int, int]]]]:
    """(bytes, its whole blocks as (type, big-endian, start, length)), piece by piece; every length is checked.

    Blocks before a fault come before its error.
    """
    data, before, big = b"", 0, False
    while True:
        more = stream.read(CHUNK)
        data = data + more if data else more
        at, found, have, fault = 0, [], len(data), None
        while have - at >= 8 and fault is None:
            kind, length = _TWO[big].unpack_from(data, at)
            if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
                if have - at < 12:
                    fault = None if more else "truncated section header"
                    break
                mark = data[at + 8 : at + 12]
                if mark not in (LITTLE_MARK, BIG_MARK):
                    fault = "bad pcapng byte-order magic"
                    break
                big = mark == BIG_MARK
                kind, length = SECTION, _ONE[big].unpack_from(data, at + 4)[0]
            fault = _fault(kind, length, size - before - at)
            if fault is not None:
                break
            if length > have - at:
                fault = None if more else "truncated or invalid pcapng block"
                break
            if _ONE[big].unpack_from(data, at + length - 4)[0] != length:
                fault = "pcapng block length trailer does not match"
                break
            found.append((kind, big, at, length))
            at += length
        if found:
            yield data, found
        data, before = data[at:], before + at
        if fault is None and not more and data:
            fault = "truncated pcapng block header"
        if fault is not None:
            raise InvalidCapture(fault)
        if not more:
            return


def _pcapng(stream: BinaryIO, size: int, with_others: bool) -> Iterator[Frames]:
    section, number, packets = -1, 0, 0
    interfaces: dict[tuple[int, int], tuple[int, Clock]] = {}
    for data, blocks in _walk(stream, size):
        rows, sections, others = [], [], []
        for block in blocks:
            kind, big, at, length = block
            if kind in (ENHANCED, PACKET, SIMPLE):
                rows.append(block)
                sections.append(section)
            elif kind == SECTION:
                section, number = section + 1, 0
            elif kind == INTERFACE:
                interfaces[section, number] = _interface(data[at : at + length], big)
                number += 1
            elif with_others:
                others.append((packets + len(rows), big, data[at : at + length]))
        yield _decoded(data, rows, np.array(sections, dtype=np.int64), interfaces, packets + 1, others)
        packets += len(rows)


def _decoded(data: bytes, rows: list, section: np.ndarray, interfaces: dict, first: int, others: list) -> Frames:
    raw = np.frombuffer(data, dtype=np.uint8)
    kind, big, at, length = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.empty(0, dtype=np.int64),) * 4
    big, simple = big.astype(bool), kind == SIMPLE
    # simple blocks are shorter than what the others hold: their places are read within the block
    place = lambda n: at + np.where(simple, 8, n)
    original = _numbers(raw, place(24), big)
    captured = np.where(simple, np.minimum(original, length - 16), _numbers(raw, place(20), big))
    start = at + np.where(simple, 12, 28)
    if (bad := ~simple & (28 + captured > length - 4)).any():
        raise InvalidCapture(f"invalid enhanced packet length in packet {first + int(bad.argmax())}")
    interface = _numbers(raw, place(8), big)
    short = np.where(big, interface >> 16, interface & 0xFFFF)  # the legacy block has 16 bits for it
    interface = np.where(simple, 0, np.where(kind == PACKET, short, interface))
    ticks = (_numbers(raw, place(12), big).astype(np.uint64) << np.uint64(32)) | _numbers(raw, place(16), big).astype(np.uint64)
    nanos, linktype = np.zeros(len(at), dtype=np.int64), np.full(len(at), ETHERNET, dtype=np.int64)
    for s, i in set(zip(section.tolist(), interface.tolist(), strict=True)):
        link, clock = interfaces.get((s, i), (ETHERNET, Clock()))
        mine = (section == s) & (interface == i)
        linktype[mine] = link
        mine &= ~simple
        nanos[mine] = clock.nanos(ticks[mine])
    return Frames(data, start, start + captured, original, nanos, ~simple, section, interface, linktype, first, others)


def _classic(stream: BinaryIO, size: int, head: bytes) -> Iterator[Frames]:
    big, tick = CLASSIC[head[:4]]
    if len(head) < 24:
        raise InvalidCapture("truncated pcap header")
    linktype = _ONE[big].unpack_from(head, 20)[0] & 0x0FFFFFFF
    record, data, before, first = struct.Struct(">IIII" if big else "<IIII"), b"", 24, 1
    while True:
        more = stream.read(CHUNK)
        data = data + more if data else more
        at, rows, fault = 0, [], None
        while len(data) - at >= 16:
            seconds, part, captured, original = record.unpack_from(data, at)
            if captured > LARGEST or captured > size - before - at - 16:
                fault = "pcap record length exceeds remaining file size"
                break
            if captured > len(data) - at - 16:
                fault = None if more else "truncated pcap record"
                break
            rows.append((at + 16, at + 16 + captured, original, seconds * NANOS + part * tick))
            at += 16 + captured
        if rows:
            start, end, wire, nanos = np.array(rows, dtype=np.int64).T
            none = np.zeros(len(rows), dtype=np.int64)
            yield Frames(data, start, end, wire, nanos, none == 0, none, none, none + linktype, first)
            first += len(rows)
        data, before = data[at:], before + at
        if fault is None and not more and data:
            fault = "truncated pcap record header"
        if fault is not None:
            raise InvalidCapture(fault)
        if not more:
            return


class _Led:
    """A stream that gives ``head`` first."""

    def __init__(self, head: bytes, stream: BinaryIO) -> None:
        self.head, self.stream = head, stream

    def read(self, n: int) -> bytes:
        head, self.head = self.head, b""
        return head + self.stream.read(n)


def frames(stream: BinaryIO, size: int, with_others: bool = False) -> Iterator[Frames]:
    """The packets of a capture of ``size`` bytes, of either format; ``with_others`` keeps blocks of other types.

    An empty file has none. Raises InvalidCapture for anything else that is no capture.
    """
    head = stream.read(24)
    if head[:4] in CLASSIC:
        yield from _classic(stream, size, head)
    elif head:
        yield from _pcapng(_Led(head, stream), size, with_others)
