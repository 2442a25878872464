"""Line-by-line models of the capture rules, for comparison only."""

from dataclasses import dataclass, field


@dataclass
class Capture:
    open_seq: int
    open_t: int
    until: int = 0
    after: int = 0
    reason: str = ""
    members: list = field(default_factory=list)
    window: list = field(default_factory=list)
    context: list = field(default_factory=list)
    left_out: dict = field(default_factory=dict)
    reusable: bool = True


def fold(lines, T, M, cap, reusable=lambda seq: True):
    """lines: (seq, t, is_match) in order; all times in one unit. Captures in opening order."""
    done, seen, current = [], [], None

    def close(reason):
        nonlocal current
        current.reason = reason
        done.append(current)
        current = None

    for seq, t, hit in lines:
        if current is not None and t > current.until:
            close("time_max" if M and current.until == current.open_t + M else "time")
        if current is None and hit:
            current = Capture(seq, t, reusable=reusable(seq))
            current.window = [s for s, at in seen if at >= t - T]
            holder = {s: c for c in done if c.reusable for s in c.context + c.members}
            for s in current.window:
                if s in holder:
                    key = holder[s].open_seq
                    current.left_out[key] = current.left_out.get(key, 0) + 1
                else:
                    current.context.append(s)
            current.members.append(seq)
        elif current is not None:
            current.members.append(seq)
            current.after += 1
        if current is not None and hit:
            current.until = min(t + T, current.open_t + M) if M else t + T
        seen.append((seq, t))
        if current is not None and current.after > cap:
            close("line_cap")
    if current is not None:
        close("end_of_input")
    return done
