"""Command line: audits the PDF files of a folder, or one file, and prints their reports, as text or one JSON line each.

Exit code 0: clean, 1: attention, 2: failed.
"""

from __future__ import annotations

import sys

from glyphlake.config import AuditOptions
from glyphlake.sources.pdf_objects import PdfError

USAGE = "usage: python -m glyphlake.cli [--json] [--pages SPEC] [--max-file-size-mib N] [--max-pages N] [--tiny-text-threshold-pt X] PATH"


def main(arguments: list[str], out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    if arguments in (["-h"], ["--help"]):
        print(USAGE, file=out)
        return 0
    try:
        options = AuditOptions.of(arguments)
    except ValueError as e:
        print(e, USAGE, sep="\n", file=err)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from glyphlake.functions import text
    from glyphlake.operators import reports
    from glyphlake.operators.steps import settled
    from glyphlake.plans.audit import audit

    spark = SparkSession.builder.appName("glyphlake").getOrCreate()
    try:
        _, files = audit(spark, options.folder, options.page_selection, options.tiny, options.most_bytes, options.most_pages)
        files = settled(files)
        good = files.filter("error IS NULL")
        told = reports.report_json(good) if options.json else reports.text_report(good)
        need = failed = 0
        for r in told.join(good.select("file_id", "attention"), "file_id").orderBy("file_id").toLocalIterator():
            need += bool(r["attention"])
            print(r["json"] if options.json else r["report"], file=out)
        bad = files.filter("error IS NOT NULL").select("file_id", "limit_code", text.escape_terminal(F.concat("file_id", F.lit(": "), "error")).alias("said"))
        for r in bad.orderBy("file_id").toLocalIterator():
            failed += 1
            if r["limit_code"]:
                print(f"failure=WORK_LIMIT_{r['limit_code']}", file=err)
            print(r["said"], file=err)
        out.flush()
    except (PdfError, OSError) as e:
        print(e, file=err)
        return 2
    return 2 if failed else 1 if need else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
