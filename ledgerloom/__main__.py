"""python -m ledgerloom investigate PATH KIND [BEFORE AFTER]: a JSON report of two periods.

Exit codes: 0 done, 1 not an export or too short, 2 wrong usage.
"""

from __future__ import annotations

import sys
from datetime import datetime, timezone


def main(arguments: list[str]) -> int:
    if len(arguments) not in (3, 5) or arguments[0] != "investigate":
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark import StorageLevel

    from ledgerloom.functions.accounting import classified
    from ledgerloom.operators import periods, usage
    from ledgerloom.report import to_json
    from ledgerloom.session import build_session
    from ledgerloom.sources.rows import ExportError, read_rows

    spark = build_session("ledgerloom")
    try:
        rows = read_rows(spark, arguments[1], arguments[2])
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        chosen = (periods.parse(arguments[3]), periods.parse(arguments[4])) if len(arguments) == 5 else periods.automatic(rows, now=now)
        if chosen is None:
            raise ExportError("the rows span less than two whole weeks; name the periods")
        periods.validate(*chosen, now=now)
    except (ExportError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    # Several aggregations read the classified rows: kept where they fit, spilled where not, computed again if lost.
    sided = classified(periods.sided(rows, *chosen)).persist(StorageLevel.MEMORY_AND_DISK)
    frames = {
        "windows": usage.windows(sided), "quality": usage.quality(sided), "models": usage.by_model(sided), "call_types": usage.call_types(sided),
        "caches": usage.cache_windows(sided), "failures": usage.failure_tokens(sided), **{f"movers_{d}": usage.movers(sided, d) for d in usage.DIMENSIONS},
    }
    sys.stdout.write(to_json(frames))
    sided.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
