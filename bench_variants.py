"""Times the chosen form of an operator against the forms it was chosen over (warm, median)."""

from __future__ import annotations

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from orebook.operators import allocation as A  # noqa: E402
from orebook.operators import backlog as B  # noqa: E402
from orebook.operators import joins as J  # noqa: E402
from orebook.operators import timegrid as G  # noqa: E402
from orebook.plans import load_all  # noqa: E402
from orebook.session import cut, local_session  # noqa: E402
from orebook.sources.tables import Tables  # noqa: E402


def main() -> None:
    load_all()
    from orebook.plans import joins as PJ
    from orebook.plans import shapes as S
    from orebook.plans import supply as SU
    from orebook.plans import windows as W

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    t = Tables(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    life = cut(S.order_life(t), "life")
    lines = cut(SU.backlog_lines(t), "lines")
    stock = cut(W.stock(t), "stock")
    wide = A.stock_by_site(stock, "l_partkey", "site", "on_hand", S.SITES)
    facts, rates = cut(PJ.dated_orders(t), "facts"), cut(PJ.monthly_rates(t), "rates")

    def naive_spine():
        lo = life.agg(F.min("order_date")).scalar()
        spine = G.spine_by_site(life.select("site").distinct(), lo, F.date_sub(F.lit(S.AS_OF), 1))
        d, o, i = F.col("dt"), F.col("order_date"), F.col("invoice_date")
        return spine.join(life, "site", "left").groupBy("dt", "site").agg(
            F.count_if(o == d), F.count_if(i == d), F.count_if((o <= d) & (i.isNull() | (i > d)))
        )

    def by_max_by():
        keys = facts.select("ccy", "order_date").distinct()
        best = keys.join(rates, "ccy", "left").filter("rate_date <= order_date").groupBy("ccy", "order_date").agg(F.max_by("rate", "rate_date").alias("rate"))
        return facts.join(best, ["ccy", "order_date"], "left")

    def by_lateral():
        facts.createOrReplaceTempView("v_facts"), rates.createOrReplaceTempView("v_rates")
        return spark.sql("""select f.*, x.rate from v_facts f left join lateral (select rate from v_rates r
            where r.ccy = f.ccy and r.rate_date <= f.order_date order by r.rate_date desc limit 1) x""")

    args = ("l_partkey", "site", "required", S.line_order(), S.line_chunks())
    cases = {
        "backlog: changes and running sum": lambda: B.backlog_daily(life, "site", "order_date", "invoice_date", S.AS_OF),
        "backlog: spine joined with orders": naive_spine,
        "tally: all sites, plain window": lambda: A.allocation_tally(lines, wide, S.SITES, *args),
        "tally: all sites, every item in chunks": lambda: A.allocation_tally(lines, wide, S.SITES, *args, large_rows=0),
        "tally: home site only": lambda: A.home_tally(lines, stock, *args),
        "as-of: stacked window": lambda: J.asof_join(facts, rates, "ccy", "order_date", "rate_date", ["rate"]),
        "as-of: distinct keys, range join, max_by": by_max_by,
        "as-of: lateral top one": by_lateral,
    }
    wanted = sys.argv[1:]
    for name, make in cases.items():
        if wanted and not any(w in name for w in wanted):
            continue
        times = []
        for _ in range(3):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if times[-1] > 20:
                break
        times = times[1:] or times  # the first run warms up, unless it is slow enough to count
        print(f"{name}: {statistics.median(times):.2f} s", flush=True)


if __name__ == "__main__":
    main()
