"""Command line.

    python -m quire list
    python -m quire query NAME --data DIR [--out PATH] [--show N]
    python -m quire store --data DIR --model DIR [--buckets N]
    python -m quire audit (--data DIR | --model DIR) --request FILE --out DIR [--objects DIR] [--status-log DIR]
    python -m quire status --status-log DIR [--org ORG] [--report ID]
    python -m quire delete --status-log DIR --org ORG --report ID
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--out")
    q.add_argument("--show", type=int, default=0)
    st = sub.add_parser("store", help="store the audit model of a data folder, partitioned and bucketed")
    st.add_argument("--data", required=True)
    st.add_argument("--model", required=True)
    st.add_argument("--buckets", type=int)
    a = sub.add_parser("audit")
    source = a.add_mutually_exclusive_group(required=True)
    source.add_argument("--data")
    source.add_argument("--model", help="stored model tables")
    a.add_argument("--request", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--objects")
    a.add_argument("--status-log")
    s = sub.add_parser("status")
    s.add_argument("--status-log", required=True)
    s.add_argument("--org")
    s.add_argument("--report")
    d = sub.add_parser("delete")
    d.add_argument("--status-log", required=True)
    d.add_argument("--org", required=True)
    d.add_argument("--report", required=True)
    args = p.parse_args(argv)

    from .plans.registry import queries

    if args.cmd == "list":
        print("\n".join(sorted(queries())))
        return 0

    from .session import build_session

    spark = build_session()
    if args.cmd == "query":
        df = queries()[args.name](spark, args.data)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        if args.show:
            df.show(args.show, truncate=False)
        if not args.out and not args.show:
            df.write.format("noop").mode("overwrite").save()
        return 0
    if args.cmd == "store":
        from .sources import layout, tables, views

        layout.write_model(spark, views.audit_tables(tables.load(spark, args.data)), args.model, args.buckets or layout.BUCKETS)
        return 0
    if args.cmd == "audit":
        from .plans.audit import run_audit_reports
        from .sources import layout, requests, tables, views

        model = layout.read_model(spark, args.model) if args.model else views.audit_tables(tables.load(spark, args.data))
        req = requests.parse_requests(requests.read_request_documents(spark, args.request))
        wrong = requests.invalid_ids(req).limit(20).collect()
        if wrong:
            print("not submission ids:", *[f"{r.report_name}[{r.position}]={r.text!r}" for r in wrong], file=sys.stderr)
            return 1
        run = run_audit_reports(spark, model, requests.request_ids(req), args.out, objects_root=args.objects,
                                status_log_dir=args.status_log)
        run.summary.show(truncate=False)
        print(f"run {run.report_id}: {run.folder.count()} csv files, {run.archives.count()} archives")
        return 0
    if args.cmd == "delete":
        from .operators import status

        status.tombstone(spark, args.org, args.report).write.mode("append").parquet(args.status_log)
        return 0
    if args.cmd == "status":
        from .operators import status

        log = spark.read.parquet(args.status_log)
        status.status_lookup(status.latest_status(log), args.org, args.report).show(truncate=False)
        return 0
    return 2


if __name__ == "__main__":
    sys.exit(main())
