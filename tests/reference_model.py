"""Plain Python models of the rules, for brute-force comparison on small inputs."""

from tideline.functions.labels import LEAP_TABLE, TAI_BASE, _epoch_ms


def leap(ms):
    off = 0
    for day, value in LEAP_TABLE:
        if _epoch_ms(day) < ms:
            off = value
    return off


def encode(ms):
    shifted = ms + leap(ms) * 1000
    return f"{shifted // 1000 + TAI_BASE:016x}{shifted % 1000 * 1_000_000:08x}"


def decode(label):
    shifted = (int(label[:16], 16) - TAI_BASE) * 1000 + int(label[16:], 16) // 1_000_000
    return shifted - leap(shifted) * 1000


def retention(files, limit_ms, min_bytes):
    """files: (label, size); returns the labels to delete, by folding oldest first."""
    files = sorted(files)
    left = sum(size for _, size in files)
    gone = []
    for label, size in files[:-1]:
        if decode(label) < limit_ms and left > min_bytes:
            gone.append(label)
            left -= size
    return gone


def failover(events, limit):
    """events: (second, kind) in order; returns (channel per poll, switch seconds)."""
    on_primary, clock = True, events[0][0]
    picks, switches = [], []
    for second, kind in events:
        if kind == "heartbeat":
            if on_primary:
                clock = second
            continue
        if second - clock >= limit:
            on_primary, clock = not on_primary, second
            switches.append(second)
        picks.append("primary" if on_primary else "secondary")
    return picks, switches
