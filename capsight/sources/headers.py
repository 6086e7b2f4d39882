"""Ethernet, IPv4/IPv6 and TCP headers of many packets at once, from one buffer of bytes."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Ethernet types, IP protocols, TCP option kinds.
IPV4, IPV6, VLANS = 0x0800, 0x86DD, (0x8100, 0x88A8)
TCP, FRAGMENT, EXTENSIONS = 6, 44, (0, 43, 60)
MSS, WINDOW_SCALE, SACK_PERMITTED = 2, 3, 4
MOST_TAGS, MOST_EXTENSIONS, MOST_OPTIONS = 2, 8, 40


@dataclass
class Bytes:
    """Packets as ranges of one buffer. Numbers beyond a packet's end read as 0; ``inside`` tells."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def inside(self, at: np.ndarray | int, size: int) -> np.ndarray:
        return self.start + at + size <= self.end

    def number(self, at: np.ndarray | int, size: int) -> np.ndarray:
        """The big-endian number of ``size`` bytes at a place counted from each packet's begin."""
        value, good = np.zeros(len(self.start), dtype=np.int64), self.inside(at, size)
        places = np.where(good, self.start + at, 0)
        if len(self.data) >= size:
            for k in range(size):
                value = (value << 8) | self.data[places + k]
        return np.where(good, value, 0)

    def taken(self, at: np.ndarray | int, size: int) -> np.ndarray:
        """(packet, byte): ``size`` bytes at a place; zeros where they aren't all inside."""
        good = self.inside(at, size)
        out = np.zeros((len(self.start), size), dtype=np.uint8)
        out[good] = self.data[(self.start + at)[good][:, None] + np.arange(size)]
        return out

    @classmethod
    def of(cls, column: pa.Array) -> Bytes:
        """The values of a binary column; null is empty."""
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        return cls(raw, at[:-1], at[1:])


@dataclass
class Headers:
    """What each packet's headers say; ``is_ip`` and ``is_tcp`` tell where the rest has a meaning.

    l3 and l4 are the places of the IP and the TCP header; header_end is where TCP's ends, or the packet.
    """

    is_ip: np.ndarray
    is_tcp: np.ndarray
    version: np.ndarray
    l3: np.ndarray
    l4: np.ndarray
    header_end: np.ndarray
    source: np.ndarray
    target: np.ndarray
    sport: np.ndarray
    dport: np.ndarray
    seq: np.ndarray
    ack: np.ndarray
    flags: np.ndarray
    window: np.ndarray
    payload: np.ndarray
    mss: np.ndarray
    scale: np.ndarray
    sack: np.ndarray


def parse(packets: Bytes, original: np.ndarray) -> Headers:
    """Headers of Ethernet frames, with up to two VLAN tags and eight IPv6 extension headers.

    Packets of other types, fragments after the first, and packets cut within a header have no TCP.
    ``original`` is the length on the wire: it stands in for an IP length of 0.
    """
    n = len(packets.start)
    kind, l3 = np.where(packets.inside(12, 2), packets.number(12, 2), 0), np.full(n, 14)
    for _ in range(MOST_TAGS):
        tagged = np.isin(kind, VLANS)
        kind, l3 = np.where(tagged, packets.number(l3 + 2, 2), kind), np.where(tagged, l3 + 4, l3)
    first = packets.number(l3, 1)
    header = np.where(kind == IPV6, 40, (first & 15) * 4)
    four, six = (kind == IPV4) & packets.inside(l3, 20) & (header >= 20), (kind == IPV6) & packets.inside(l3, 40)
    protocol = np.where(four, packets.number(l3 + 9, 1), np.where(six, packets.number(l3 + 6, 1), -1))
    whole = ~four | (packets.number(l3 + 6, 2) & 0x1FFF == 0)
    l4 = l3 + header
    for _ in range(MOST_EXTENSIONS):
        longer, part = six & np.isin(protocol, EXTENSIONS), six & (protocol == FRAGMENT)
        if not (longer | part).any():
            break
        whole &= ~part | (packets.number(l4 + 2, 2) >> 3 == 0)
        size = np.where(part, 8, (packets.number(l4 + 1, 1) + 1) * 8)
        protocol = np.where(longer | part, packets.number(l4, 1), protocol)
        l4 = np.where(longer | part, l4 + size, l4)
    is_tcp = (four | six) & (protocol == TCP) & whole & packets.inside(l4, 20)
    offset = (packets.number(l4 + 12, 1) >> 4) * 4
    length = np.where(four, packets.number(l3 + 2, 2), packets.number(l3 + 4, 2) + 40)
    length = np.where(np.where(four, length == 0, length == 40), original - l3, length)
    mss, scale, sack = _options(packets, np.where(is_tcp, l4 + 20, 0), np.where(is_tcp, l4 + offset, 0))
    wide = lambda at4, at6: np.where(four[:, None], np.pad(packets.taken(l3 + at4, 4), ((0, 0), (0, 12))), packets.taken(l3 + at6, 16))
    return Headers(
        is_ip=four | six, is_tcp=is_tcp, version=np.where(four, 4, np.where(six, 6, 0)), l3=l3, l4=l4,
        header_end=np.minimum(l4 + offset, packets.end - packets.start), source=wide(12, 8), target=wide(16, 24),
        sport=packets.number(l4, 2), dport=packets.number(l4 + 2, 2), seq=packets.number(l4 + 4, 4), ack=packets.number(l4 + 8, 4),
        flags=packets.number(l4 + 12, 2) & 0x1FF, window=packets.number(l4 + 14, 2),
        payload=np.maximum(length - (l4 - l3) - offset, 0), mss=mss, scale=scale, sack=sack,
    )


def _options(packets: Bytes, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(MSS, window scale, whether SACK is permitted); -1 where an option isn't there. The first of several counts."""
    mss, scale, sack = np.full(len(at), -1), np.full(len(at), -1), np.zeros(len(at), dtype=bool)
    stop = np.minimum(stop, packets.end - packets.start)
    for _ in range(MOST_OPTIONS):
        kind = packets.number(at, 1)
        live = (at < stop) & (kind != 0)
        if not live.any():
            break
        size = np.where(kind == 1, 1, packets.number(at + 1, 1))
        live &= (size >= np.where(kind == 1, 1, 2)) & (at + size <= stop)
        mss = np.where(live & (kind == MSS) & (size == 4) & (mss < 0), packets.number(at + 2, 2), mss)
        scale = np.where(live & (kind == WINDOW_SCALE) & (size == 3) & (scale < 0), packets.number(at + 2, 1), scale)
        sack |= live & (kind == SACK_PERMITTED)
        at = np.where(live, at + size, stop)
    return mss, scale, sack


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the index of each row's) of a uint8 matrix."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    return rows[first], inverse


def _text(address: bytes, version: int) -> str:
    return str(ipaddress.IPv4Address(address[:4]) if version == 4 else ipaddress.IPv6Address(address))


def address_texts(addresses: np.ndarray, version: np.ndarray) -> pa.Array:
    """Printed addresses, null where the version is 0; each distinct one is printed once."""
    found, index = _distinct(np.column_stack([version.astype(np.uint8), addresses]))
    texts = pa.array([_text(row[1:].tobytes(), row[0]) if row[0] else None for row in found], pa.string())
    return texts.take(pa.array(index))


def flow_texts(headers: Headers) -> pa.Array:
    """``a:p<->b:q`` with the lower endpoint first, by address bytes and then port; null without TCP."""
    ports = np.column_stack([headers.sport, headers.dport]).astype(">u2").view(np.uint8).reshape(-1, 4)
    ends = [np.column_stack([headers.source, ports[:, :2]]), np.column_stack([headers.target, ports[:, 2:]])]
    first = (ends[0] != ends[1]).argmax(1)
    at = np.arange(len(first)), first
    swapped = (ends[0][at] > ends[1][at])[:, None]
    version = np.where(headers.is_tcp, headers.version, 0).astype(np.uint8)
    found, index = _distinct(np.column_stack([version, np.where(swapped, ends[1], ends[0]), np.where(swapped, ends[0], ends[1])]))

    def end(row: np.ndarray, version: int) -> str:
        text = _text(row[:16].tobytes(), version)
        return f"[{text}]:{int(row[16]) << 8 | int(row[17])}" if version == 6 else f"{text}:{int(row[16]) << 8 | int(row[17])}"

    texts = [f"{end(row[1:19], row[0])}<->{end(row[19:], row[0])}" if row[0] else None for row in found]
    return pa.array(texts, pa.string()).take(pa.array(index))


def header_sums(headers: np.ndarray) -> np.ndarray:
    """The ones'-complement sums of 16-bit words of the rows of a uint8 matrix of even width, complemented."""
    total = headers.reshape(len(headers), -1, 2).astype(np.int64) @ np.array([256, 1])
    total = total.sum(1)
    for _ in range(2):
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF
