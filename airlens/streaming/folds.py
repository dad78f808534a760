"""Per-key rules as folds: ``step`` takes one row and returns the rows it releases.

A fold is the single statement of a stateful rule. The streaming operators run it inside typed keyed state, and tests run
it over random inputs as the yardstick for the batch operators. Where many rows in a row do the plain thing, ``stretch``
takes them at once, as arrays; what it gives is what ``step`` would.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

from airlens.operators.cues import GAP_MS, MAX_MS, MIN_MS
from airlens.operators.rtp import GAP_MAX


class Fold:
    """Rule of one key. ``state`` is a dict, ``{}`` at the start and when there is nothing to remember."""

    output = ""  # columns of released rows
    order: list[str] = []  # columns that order the rows of a key
    state = ""  # typed fields of the state
    maps: dict[str, tuple[str, str]] = {}  # entries of the state that are maps: types of key and value

    def step(self, state: dict, row: dict) -> list[tuple]:
        raise NotImplementedError

    def stretch(self, state: dict, rows: dict[str, np.ndarray], at: int, end: int) -> tuple[int, list[tuple]]:
        """Takes rows ``at`` to the returned one at once, with what they release; ``at`` itself if they need ``step``."""
        return at, []

    def deadline(self, state: dict) -> int | None:
        """Event time in microseconds at which ``expire`` must run; None for never."""
        return None

    def expire(self, state: dict, now_us: int) -> list[tuple]:
        return []

    def finish(self, state: dict, row: dict) -> list[tuple]:
        """What the end of the stream releases; ``row`` is the closing row, whose time is the end's."""
        return []

    @staticmethod
    def packed(state: dict) -> dict:
        """The state as its typed fields and maps have it."""
        return state

    @staticmethod
    def unpacked(state: dict) -> dict:
        return state


def _run_end(breaks: np.ndarray, at: int, end: int) -> int:
    """End of the run that holds ``at``: ``breaks`` are the rows that do not go on from the one before them."""
    i = int(np.searchsorted(breaks, at, side="right"))
    return min(int(breaks[i]), end) if i < len(breaks) else end


class MetricStore(Fold):
    """Latest snapshot of an instance; silence frees it, so a lower sequence is accepted afterwards (STR-1).

    The closing row ends the observation: an instance silent for longer than the limit by then is gone, others are not.
    """

    output = "event string, arrival bigint, process_start bigint, sequence bigint, recv_us bigint"
    order = ["recv_us", "arrival"]
    state = "process_start bigint, sequence bigint, recv_us bigint, arrival bigint"

    def __init__(self, expiry_us: int = 30_000_000):
        self.expiry_us = expiry_us

    def step(self, state, row):
        out = self.expire(state, int(row["recv_us"])) if state else []
        if state and row["process_start"] == state["process_start"] and row["sequence"] <= state["sequence"]:
            return out
        state.update({k: int(row[k]) for k in ("process_start", "sequence", "recv_us", "arrival")})
        return out + [("accepted", state["arrival"], state["process_start"], state["sequence"], state["recv_us"])]

    def stretch(self, state, rows, at, end):
        """Rising sequences of one process, none of them later than the limit: all accepted."""
        start, number, time = rows["process_start"], rows["sequence"], rows["recv_us"]
        if "__breaks" not in rows:
            goes_on = (start[1:] == start[:-1]) & (number[1:] > number[:-1]) & (time[1:] - time[:-1] <= self.expiry_us)
            rows["__breaks"] = np.flatnonzero(~goes_on) + 1
        if not state or start[at] != state["process_start"] or number[at] <= state["sequence"] or time[at] - state["recv_us"] > self.expiry_us:
            return at, []
        stop = _run_end(rows["__breaks"], at, end)
        columns = [rows[k][at:stop].tolist() for k in ("arrival", "process_start", "sequence", "recv_us")]
        state.update({k: int(rows[k][stop - 1]) for k in ("process_start", "sequence", "recv_us", "arrival")})
        return stop, [("accepted", *r) for r in zip(*columns, strict=True)]

    def deadline(self, state):
        return state["recv_us"] + self.expiry_us + 1 if state else None

    def expire(self, state, now_us):
        if not state or now_us <= state["recv_us"] + self.expiry_us:
            return []
        gone = ("expired", state["arrival"], state["process_start"], state["sequence"], state["recv_us"])
        state.clear()
        return [gone]

    def finish(self, state, row):
        return self.expire(state, int(row["recv_us"]))


class RtpRepair(Fold):
    """Reordering and repair of one channel: a gap is held until filled or its deadline (STR-2).

    Rows: ``kind ('original'|'repair'), arrival, arrival_us, ssrc, seq, payload_len``; seq is the original number in both.
    """

    output = "run bigint, seq int, source string"
    order = ["arrival"]
    state = "run bigint, ssrc bigint, expected int, deadline bigint, size int"
    maps = {"hold": ("number int", "source string")}  # places of the window that are filled, by number

    def __init__(self, wait_us: int = 200_000, hold_bytes: int | None = None):
        self.wait_us, self.hold_bytes = wait_us, hold_bytes

    def _release(self, state, lost_too: bool) -> list[tuple]:
        """Hand out the front of the window: filled places always, open ones only with ``lost_too``."""
        out = []
        while state["hold"] and (state["hold"][0] or lost_too):
            out.append((state["run"], state["expected"], state["hold"].pop(0) or "lost"))
            state["expected"] = (state["expected"] + 1) % 65536
        return out

    def _original(self, state, seq, small, at) -> list[tuple]:
        ahead = (seq - state["expected"] + 32768) % 65536 - 32768
        hold = state["hold"]
        if ahead < 0:
            return []
        if hold:
            if ahead < len(hold):
                if hold[ahead] is None and small:
                    hold[ahead] = "reordered"
                return []
            if ahead == len(hold) < GAP_MAX and small:
                hold.append("ok")
                return []
            return self._release(state, True) + self._original(state, seq, small, at)
        if ahead == 0 or ahead >= GAP_MAX or not small:
            state["expected"] = (seq + 1) % 65536
            return [(state["run"], seq, "ok" if ahead == 0 else "resync")]
        state["hold"] = [None] * ahead + ["gap"]
        state["deadline"] = at + self.wait_us
        return []

    def step(self, state, row):
        seq, ssrc, at = int(row["seq"]), int(row["ssrc"]), int(row["arrival_us"])
        small = self.hold_bytes is None or row["payload_len"] <= self.hold_bytes
        out = self.expire(state, at - 1) if state else []
        if row["kind"] == "original":
            if state.get("ssrc") != ssrc:
                out += self._release(state, True) if state else []
                state.update(ssrc=ssrc, expected=seq, hold=[], run=state.get("run", -1) + 1)
            out += self._original(state, seq, small, at)
        elif state and ssrc == state["ssrc"] and small:
            ahead = (seq - state["expected"] + 32768) % 65536 - 32768
            if 0 <= ahead < len(state["hold"]) and state["hold"][ahead] is None:
                state["hold"][ahead] = "repaired"
        if state and state["hold"]:
            out += self._release(state, at > state["deadline"])
        return out

    def deadline(self, state):
        return state["deadline"] if state and state["hold"] else None

    def expire(self, state, now_us):
        return self._release(state, True) if state and state["hold"] and now_us >= state["deadline"] else []

    def finish(self, state, row):
        return self._release(state, True) if state else []

    def stretch(self, state, rows, at, end):
        """Packets in order while nothing is held; retransmissions then do nothing."""
        if "__breaks" not in rows:
            first = rows["kind"] == "original"
            number, owner = rows["seq"].astype(np.int64), rows["ssrc"]
            goes_on = first[1:] & first[:-1] & (owner[1:] == owner[:-1]) & ((number[1:] - number[:-1]) % 65536 == 1)
            rows["__first"], rows["__breaks"] = first, np.flatnonzero(~goes_on) + 1
        if not state or state["hold"] or not rows["__first"][at] or rows["ssrc"][at] != state["ssrc"] or rows["seq"][at] != state["expected"]:
            return at, []
        stop = _run_end(rows["__breaks"], at, end)
        state["expected"] = (int(rows["seq"][stop - 1]) + 1) % 65536
        return stop, [(state["run"], n, "ok") for n in rows["seq"][at:stop].tolist()]

    @staticmethod
    def packed(state: dict) -> dict:
        """The state with its window as a map from number to source."""
        hold = state.get("hold", [])
        return {**state, "size": len(hold), "hold": {(state["expected"] + i) % 65536: s for i, s in enumerate(hold) if s}} if state else {}

    @staticmethod
    def unpacked(state: dict) -> dict:
        return {**state, "hold": [state["hold"].get((state["expected"] + i) % 65536) for i in range(state["size"])]} if state else {}


_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_POLY, _ALL = 0x104C11DB7, 0xFFFFFFFF  # fixed values: the checksum's polynomial and its start


def part_crc(data: bytes) -> int:
    """What ``data`` adds to the checksum of a document, whatever stands before it."""
    # the library's checksum reads bits from the other end
    return int(f"{zlib.crc32(bytes(data).translate(_MIRROR), _ALL) ^ _ALL:032b}"[::-1], 2)


def _times(a: int, b: int) -> int:
    """Product of two remainders of the polynomial."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a <<= 1
        if a >> 32:
            a ^= _POLY
        b >>= 1
    return out


@lru_cache(4096)  # most parts of a document are of one size
def _shift(size: int) -> int:
    """What ``size`` more bytes multiply a remainder by: x to the number of their bits."""
    power, shift, n = 2, 1, 8 * size
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return shift


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """Checksum of a document from ``(part_crc, size)`` of its parts in order: no part is read again."""
    total = _ALL
    for crc, size in parts:
        total = _times(total, _shift(size)) ^ crc
    return total


class DocReassembly(Fold):
    """Document from numbered sections; a new version or length starts over (STR-3).

    The first copy of a section counts, and a run of one version and length gives its document once. With ``crc_present``
    only the last section may carry a checksum, and the document is released only if it is the document's own; it follows
    from checksums of the sections, so nothing is joined before. Payloads are binary, or text without checksums.
    """

    output = "version int, document binary"
    order = ["arrival"]
    state = "version int, last int, count int, done boolean, wanted bigint"
    maps = {"parts": ("number int", "payload binary, crc bigint, size bigint")}

    def step(self, state, row):
        number, last, version = int(row["section_number"]), int(row["last_section_number"]), int(row["version"])
        checked = bool(row.get("crc_present"))
        crc = row.get("crc")
        if number > last or checked and (number != last or crc is None or crc != crc):
            return []
        if (state.get("version"), state.get("last")) != (version, last):
            parts = state.pop("parts", {})
            parts.clear()
            state.update(version=version, last=last, count=0, done=False, wanted=None, parts=parts)
        if state["done"] or number in state["parts"]:
            return []
        payload = row["payload"].encode() if isinstance(row["payload"], str) else bytes(row["payload"])
        state["parts"][number] = (payload, part_crc(payload), len(payload))
        state["count"] += 1
        if checked:
            state["wanted"] = int(crc)
        if state["count"] <= last:
            return []
        parts = [state["parts"][i] for i in range(last + 1)]
        state["parts"].clear()
        state["done"] = True
        if state.get("wanted") is not None and joined_crc([p[1:] for p in parts]) != state["wanted"]:
            return []
        return [(version, b"".join(p[0] for p in parts))]


class ExactBitrate(Fold):
    """Bitrate windows closed by the first packet two whole seconds later (STR-4, exact). A window that nothing closes is
    never known, so the end of the stream gives no row."""

    output = "open_s bigint, close_s bigint, bytes bigint, bps double"
    order = ["arrival"]
    state = "open bigint, bytes bigint"

    def __init__(self, window_s: int = 2):
        self.window_s = window_s

    def step(self, state, row):
        second = int(row["arrival_us"]) // 1_000_000
        opened = state.setdefault("open", second)
        state["bytes"] = state.get("bytes", 0) + int(row["payload_len"])
        if second - opened < self.window_s:
            return []
        total = state["bytes"]
        state.update(open=second, bytes=0)
        return [(opened, second, total, total * 8 / (second - opened))]

    def stretch(self, state, rows, at, end):
        """Packets before the one that closes the window."""
        if not state:
            return at, []
        limit, size = (state["open"] + self.window_s) * 1_000_000, 64
        stop = at
        while stop < end:
            later = np.flatnonzero(rows["arrival_us"][stop : min(stop + size, end)] >= limit)
            if len(later):
                stop += int(later[0])
                break
            stop, size = min(stop + size, end), 4 * size
        state["bytes"] += int(rows["payload_len"][at:stop].sum())
        return stop, []


class Integrity(Fold):
    """Integrity counters of one pid (STR-7): a row for each micro-batch of the key, the totals so far."""

    output = "pkt_no bigint, packets bigint, continuity_errors bigint, discontinuities bigint, pcr_discontinuities bigint"
    order = ["pkt_no"]
    state = "packets bigint, cc_errors bigint, disc bigint, jumps bigint, cc int, clock bigint, at bigint"

    def step(self, state, row):
        return self.stretch(state, {k: np.array([v], object if v is None else None) for k, v in row.items()}, 0, 1)[1]

    def stretch(self, state, rows, at, end):
        """All rows: each counter is a sum over neighbours, the first of which comes from the state."""
        for name in ("packets", "cc_errors", "disc", "jumps"):
            state.setdefault(name, 0)
        held = {k: rows[k][at:end] for k in ("pkt_no", "arrival_us", "has_payload", "disc", "cc", "pcr27")}
        flagged, loaded = held["disc"].astype(np.int64) != 0, held["has_payload"].astype(np.int64) != 0
        state["packets"] += end - at
        state["disc"] += int(flagged.sum())
        cc = held["cc"][loaded].astype(np.int64)
        if len(cc):
            before = np.append(cc[0] - 1 if state.get("cc") is None else state["cc"], cc[:-1])
            state["cc_errors"] += int(((cc != (before + 1) % 16) & ~flagged[loaded] & ~((np.arange(len(cc)) == 0) & (state.get("cc") is None))).sum())
            state["cc"] = int(cc[-1])
        known = np.array([x is not None and x == x for x in held["pcr27"].tolist()], bool)
        if known.any():
            clock, time = held["pcr27"][known].astype(np.int64), held["arrival_us"][known].astype(np.int64)
            if state.get("clock") is not None:
                clock, time = np.append(state["clock"], clock), np.append(state["at"], time)
            step, wall = np.diff(clock) % ((1 << 33) * 300), np.diff(time) * 27
            fine = (wall > 0) & (step > 0) & (step < 60 * 27_000_000) & (step < wall * 5 + 13_500_000) & (step * 10 > wall * 2 - 27_000_000)
            state["jumps"] += int((~fine).sum())
            state.update(clock=int(clock[-1]), at=int(time[-1]))
        return end, [(int(held["pkt_no"][-1]), state["packets"], state["cc_errors"], state["disc"], state["jumps"])]


class ServiceDiscovery(Fold):
    """Programs of one capture as tables arrive; done when all are named or time is up (STR-8).

    Rows: ``us, ord, kind ('pat'|'pmt'|'sdt'), program_number, pmt_pid, service_name``.
    """

    output = "outcome string, program_number int, pmt_pid int, resolved boolean, service_name string"
    order = ["us", "ord"]
    state = "first_us bigint, done boolean"
    maps = {"programs": ("number int", "pid int, resolved boolean, name string")}

    def __init__(self, budget_us: int = 5_000_000):
        self.budget_us = budget_us

    def _report(self, state, outcome):
        found = [(outcome, int(n), pid, resolved, name) for n, (pid, resolved, name) in state["programs"].items()]
        state["programs"].clear()
        state["done"] = True
        return found

    def step(self, state, row):
        state.setdefault("programs", {})
        state.setdefault("first_us", int(row["us"]))
        out = self.expire(state, int(row["us"]) - 1)
        if state.get("done"):
            return out
        number, known = int(row["program_number"]), state["programs"]
        pid, resolved, name = known[number] if number in known else (None, False, None)
        if row["kind"] == "pat" and number != 0 and number not in known:
            known[number] = (int(row["pmt_pid"]), False, None)
        elif number in known and row["kind"] == "pmt":
            known[number] = (pid, True, name)
        elif number in known and row["kind"] == "sdt" and row["service_name"]:
            known[number] = (pid, resolved, row["service_name"])
        programs = [p for _, p in known.items()]
        if programs and all(resolved and name for _, resolved, name in programs):
            return out + self._report(state, "complete")
        return out

    def stretch(self, state, rows, at, end):
        """Nothing counts once the report is out."""
        return (end if state.get("done") else at), []

    def deadline(self, state):
        return None if not state or state.get("done") else state["first_us"] + self.budget_us

    def expire(self, state, now_us):
        end = self.deadline(state)
        return self._report(state, "timeout") if end is not None and now_us >= end else []

    def finish(self, state, row):
        return [] if not state or state.get("done") else self._report(state, "timeout")


class Cues(Fold):
    """Subtitle cues of one capture (STR-10). The closing row ends the last one."""

    output = "start_ms bigint, end_ms bigint, text string"
    order = ["i"]
    state = "cur string, cur_start bigint, shown boolean, rows array<string>, start bigint, last bigint, last_ms bigint"

    def __init__(self, lead_ms: int = 0):
        self.lead_ms = lead_ms

    def _cue(self, state, end):
        if state.get("cur") is None or state.get("shown"):
            return []
        start, end = state["cur_start"], min(end, state["cur_start"] + MAX_MS)
        state["shown"] = True
        return [(max(start - self.lead_ms, 0), end - self.lead_ms, state["cur"])] if end > start else []

    def _close(self, state):
        lines = [r.lstrip(" ") for r in state.pop("rows", [])]
        text = "\n".join(t for t in lines if t)
        if not text or text == state.get("cur"):
            return []
        out = self._cue(state, state["start"])
        state.update(cur=text, cur_start=state["start"], shown=False)
        return out

    def step(self, state, row):
        at, text = int(row["ts_ms"]), row["text"].rstrip(" ")
        state["last_ms"] = at
        if not text:
            return []
        out = []
        if state.get("rows") and at - state["last"] > GAP_MS:
            out = self._close(state)
        if not state.get("rows"):
            state.update(rows=[], start=at)
        state["last"] = at
        if text not in state["rows"]:
            state["rows"].append(text)
        return out

    def deadline(self, state):
        if state.get("rows"):
            return (state["last"] + GAP_MS + 1) * 1000
        return None if state.get("cur") is None or state.get("shown") else (state["cur_start"] + MAX_MS) * 1000

    def expire(self, state, now_us):
        out = self._close(state) if state.get("rows") and now_us > (state["last"] + GAP_MS) * 1000 else []
        # nothing can end a cue earlier once its longest time is over
        if not state.get("rows") and state.get("cur") is not None and now_us >= (state["cur_start"] + MAX_MS) * 1000:
            out += self._cue(state, state["cur_start"] + MAX_MS)
        return out

    def finish(self, state, row):
        out = self._close(state) if state.get("rows") else []
        return out + self._cue(state, max(state.get("last_ms") or 0, (state.get("cur_start") or 0) + MIN_MS))


def run(fold: Fold, rows: list[dict], ends: dict | None = None) -> list[tuple]:
    """All rows a fold releases over one key's rows, in order; with a closing row ``ends`` those of the end too."""
    state: dict = {}
    out = [o for row in rows for o in fold.step(state, row)]
    return out + (fold.finish(state, ends) if ends is not None else [])
