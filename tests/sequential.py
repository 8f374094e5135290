"""Plain one-event-at-a-time replay, the yardstick for the set-wise one."""

import random


def random_log(n, seed, keys=12, hot=0.35):
    """Events as (seq, table, pk, op, payload); one key takes a third of them."""
    rng = random.Random(seed)
    log = []
    for seq in rng.sample(range(4 * n), n):
        pk = "1" if rng.random() < hot else str(rng.randrange(2, keys))
        op = rng.choices(["insert", "update", "snapshot", "delete"], [4, 5, 2, 2])[0]
        payload = {"id": pk}
        for name in ("a", "b", "c"):
            if rng.random() < 0.5:
                payload[name] = None if rng.random() < 0.2 else str(rng.randrange(100))
        log.append((seq, f"t{rng.randrange(2)}", pk, op, payload))
    return log


def replay(log, policy, state=None):
    """(state, sequence numbers of refused second inserts)."""
    state = {k: dict(v) for k, v in (state or {}).items()}
    refused = []
    for seq, table, pk, op, payload in sorted(log, key=lambda e: e[0]):
        key = (table, pk)
        if op == "delete":
            state.pop(key, None)
        elif policy == "upsert":
            state.setdefault(key, {}).update(payload)
        elif key not in state:
            state[key] = dict(payload)
        elif policy == "replace":
            refused.append(seq)
    return state, refused
