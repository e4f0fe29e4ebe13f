"""Return lot matching against a plain simulation, with groups cut and uncut."""

import datetime
import random
import zlib
from collections import defaultdict

from paperloom.llm import returns

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, client_id string, part int"
SALES = "sale_id long, client_id long, day int, units string"
EPOCH = datetime.datetime(1970, 1, 1)


def made_up(seed, n=900):
    deal = random.Random(seed)
    sales = [(s, deal.choice([1, 1, 1, 2, 3, None]), 0, "x") for s in range(n // 4)] + [(None, 1, 0, "x")]
    lines = []
    for k in range(n):
        sale, item = deal.choice([0, deal.randrange(n // 4), None if k % 50 == 0 else 1]), deal.choice([7, 7, 8, None if k % 30 == 0 else 9, 10 + deal.randrange(60)])
        amount = None if k % 41 == 0 else round(deal.uniform(1, 300), 2)
        shipped = None if k % 43 == 0 else EPOCH + datetime.timedelta(days=19700 + deal.randrange(40), hours=deal.randrange(24))
        lines.append((sale, deal.choice([1, 2, 3, None]), item, deal.choice([1, 2, 5, 50, 0 if k % 60 == 0 else 3, None]), amount, deal.choice([0.0, 0.05, 0.1, None]), deal.choice(["kept", "returned", "swapped", None]), shipped, "clash", 5))
    return lines + lines[:25], sales


def brute(lines, sales):
    clients, groups = defaultdict(list), defaultdict(lambda: ([], []))
    for sale, client, *_ in sales:
        if sale is not None and client is not None:
            clients[sale].append(client)
    for sale, line, item, q, amount, discount, flag, shipped, *_ in lines:
        for client in clients.get(sale, ()):
            if None in (item, amount, shipped, q) or q < 1:
                continue
            c, d, day = int(100 * amount + 0.5), int(100 * (discount or 0.0) + 0.5), (shipped - EPOCH).days
            lots, back = groups[client, item]
            key = (sale, -1 if line is None else line, q, c, d)
            lots.append([day, *key, q])
            h = zlib.crc32(f"{sale}:{'' if line is None else line}".encode())
            if flag == "returned":
                back.append((day + 1 + h % 7, *key, 1 + h % (q + 1)))
    out = []
    for (client, item), (lots, back) in groups.items():
        lots.sort()
        for number, (day, sale, _, q, c, d, units) in enumerate(sorted(back), 1):
            refund, given, piece = lambda n, q=q, c=c, d=d: n * c * (100 - d) // (100 * q), 0, 0
            for lot in lots:
                n = min(units - given, lot[6]) if lot[0] < day else 0
                if n:
                    piece += 1
                    taken = lot[3] - lot[6]
                    lot[6] -= n
                    cents = refund(given + n) - refund(given)
                    cost = (taken + n) * lot[4] // lot[3] - taken * lot[4] // lot[3]
                    out.append((client, item, number, piece, day, sale, lot[1], None if lot[2] < 0 else lot[2], n, lot[6], cents, cents - cost))
                    given += n
            if given < units:
                out.append((client, item, number, piece + 1, day, sale, None, None, units - given, None, refund(units) - refund(given), None))
    return sorted(out, key=str)


def test_pieces_equal_a_plain_simulation(spark):
    lines, sales = made_up(1)
    frames = spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(sales, SALES)
    for task in (returns.TASK, 3):
        got = sorted(map(tuple, returns.match(*frames, task=task).select(*returns.RESULT).collect()), key=str)
        assert got == brute(lines, sales)
    assert any(r[6] is None for r in got) and max(r[3] for r in got) > 2
    assert returns.match(frames[0].limit(0), frames[1]).count() == 0


def test_busy_periods_end_where_stock_does(spark):
    at = lambda d: EPOCH + datetime.timedelta(days=d)
    ids = [(s, n) for s in range(200) for n in range(1, 4)]
    h = {x: zlib.crc32(f"{x[0]}:{x[1]}".encode()) for x in ids}
    two = next(x for x in ids if h[x] % 3 == 1)  # of two units, both come back
    lines = [(two[0], two[1], 5, 2, 10.0, 0.0, "returned", at(100), "c", 1), (two[0], two[1] + 5, 5, 4, 10.0, 0.0, "kept", at(200), "c", 1), (two[0], two[1], 5, 2, 10.0, 0.0, "returned", at(300), "c", 1)]
    events = returns.events_of(returns.written(returns.used_lots(spark.createDataFrame(lines, LINES), spark.createDataFrame([(two[0], 1, 0, "")], SALES))))
    flows = returns.flows_of(events).orderBy("day", "kind").collect()
    assert [(r["kind"], r["period"], r["shipped"], r["found_by"]) for r in flows] == [(1, 0, 0, 0), (0, 0, 2, 2), (1, 1, 2, 2), (1, 1, 6, 2), (0, 1, 8, 4)]
