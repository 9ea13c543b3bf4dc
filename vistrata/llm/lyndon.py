"""Suffix arrays by linear grouping (Baier, "Linear-time suffix sorting", CPM 2016).

Suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending
order. The pointer from each suffix of a group leads to the nearest earlier position
that lies in a smaller group; the positions reached get the group's word appended to
theirs, once per pointer, so those of one group move, by their number of pointers, to
new groups right behind it. When all groups are done, their order is that of the
Lyndon prefixes, and one ascending pass emits the order inside every group: what ends
where a placed suffix begins follows along the pointers. Nothing is renamed or recursed.
"""

from __future__ import annotations


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order.

    A suffix that is a prefix of another comes first.
    """
    n = len(text)
    if not n:
        return []
    symbols = sorted(set(text))
    code = {symbol: g for g, symbol in enumerate(symbols)}
    group = [code[symbol] for symbol in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    # Groups as a chain in ascending order.
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    skip = list(range(n))  # leads over positions whose group is done
    pointer = [-1] * n
    order = []
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            order.append(g)
            for i in own:
                skip[i] = i - 1
            reached: dict[int, int] = {}
            for i in own:
                j = i - 1
                if j >= 0 and skip[j] != j:
                    while j >= 0 and skip[j] != j:
                        j = skip[j]
                    k = i - 1  # shorten the way for later
                    while k != j:
                        skip[k], k = j, skip[k]
                pointer[i] = j
                if j >= 0:
                    reached[j] = reached.get(j, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j, count in reached.items():
                moved.setdefault((group[j], count), []).append(j)
            top, behind = -1, -1
            for low, count in sorted(moved):
                new = len(members)
                members.append(moved[low, count])
                for j in moved[low, count]:
                    group[j] = new
                # Behind its old group, and behind the parts with fewer pointers.
                after = top if low == behind else low
                below.append(after)
                above.append(above[after])
                below[above[after]] = new
                above[after] = new
                top, behind = new, low
        members[g] = own
        g = below[g]

    place = [0] * len(members)
    at = 0
    for g in reversed(order):
        place[g] = at
        at += len(members[g])
    out = [-1] * n
    waiting = [True] * n
    i = n  # the empty suffix comes first
    for at in range(-1, n - 1):
        if at >= 0:
            i = out[at]
        j = i - 1
        while j >= 0 and waiting[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            waiting[j] = False
            j = pointer[j]
    return out
