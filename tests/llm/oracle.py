"""``python -m tests.llm.oracle [name…]``: queries of the subpackage next to their SQL."""

from __future__ import annotations

import sys
import time

from draftlake.llm.queries import load
from tests.oracle import SF, connection, rows


def compare(spark, name, folder: str = SF):
    queries, oracles = load()
    start = time.time()
    df = queries[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if name not in oracles:
        return bool(got[0]), f"rows={len(got[0])} (no oracle)", seconds
    cur = connection(folder).execute(oracles[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[1] != want[1]:
        return False, f"columns {got[1]} != {want[1]}", seconds
    extra, lack = sorted(set(got[0]) - set(want[0])), sorted(set(want[0]) - set(got[0]))
    return got[0] == want[0] and bool(got[0]), f"rows {len(got[0])} {len(want[0])} only spark {extra[:2]} only duck {lack[:2]}", seconds


if __name__ == "__main__":
    from draftlake.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[1:] or list(load()[0]):
        ok, note, sec = compare(session, n)
        print(f"{'ok  ' if ok else 'FAIL'} {n} {sec:.2f}s {note[:1500]}", flush=True)
