"""Command line: reconcile landed payloads into a store, and create users.

Exit status 2 for a bad argument, 1 for a failed run.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from mergewell.functions.values import parse_iso, time_window


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mergewell")
    top.add_argument("--store", default="warehouse/store")
    commands = top.add_subparsers(dest="command", required=True)
    reconcile = commands.add_parser("reconcile").add_subparsers(dest="source", required=True)
    scrobbles = reconcile.add_parser("lastfm")
    scrobbles.add_argument("--pages", required=True, help="landed scrobble pages, JSON lines")
    scrobbles.add_argument("--user-id", required=True)
    scrobbles.add_argument("--max-events", type=int)
    scrobbles.add_argument("--start", help="exclusive lower bound, ISO time")
    scrobbles.add_argument("--end", help="inclusive upper bound, ISO time")
    scrobbles.add_argument("--lookback-hours", type=float)
    library = reconcile.add_parser("spotify")
    library.add_argument("--user-id", required=True)
    for branch in ("tracks", "albums", "artists"):
        library.add_argument(f"--{branch}", help=f"landed pages of saved {branch}, JSON lines")
        library.add_argument(f"--max-{branch}", type=int)
    releases = reconcile.add_parser("musicbrainz-releases")
    releases.add_argument("--releases", required=True, help="landed release payloads, JSON lines")
    releases.add_argument("--picks", help="JSON lines of release_id, requested and resolved id")
    releases.add_argument("--limit", type=int)
    user = commands.add_parser("user").add_subparsers(dest="action", required=True).add_parser("create")
    user.add_argument("--display-name", required=True)
    user.add_argument("--email")
    user.add_argument("--lastfm-user")
    user.add_argument("--spotify-user-id")
    return top


def window(args: argparse.Namespace):
    start, end = (parse_iso(x) if x else None for x in (args.start, args.end))
    return time_window(start, end, args.lookback_hours)


def reconcile_scrobbles(spark, args: argparse.Namespace) -> list[dict]:
    """One run over landed pages; the counters of the engine."""
    from pyspark.sql import functions as F

    from mergewell.operators.persist import Store
    from mergewell.plans.engine import State, ingest_play_events
    from mergewell.sources import payloads
    from mergewell.sources.translate import scrobble_claims

    start, end = window(args)
    store = Store(spark, args.store)
    state = State.load(store)
    if start is None:  # go on where the stored events end
        start = state.play_events.agg(F.max("played_at")).first()[0]
    rows = payloads.scrobbles(payloads.read(spark, args.pages, payloads.SCROBBLE_PAGE)).withColumn("user_id", F.lit(args.user_id))
    if args.max_events is not None:
        rows = rows.where(~F.col("now_playing")).orderBy("ord").limit(args.max_events)
    bound = lambda t: F.lit(t) if t is not None else None
    out = ingest_play_events(*scrobble_claims(rows), state, bound(start), bound(end))
    out.state.save(store)
    return [r.asDict() for r in out.counters.collect()]


def reconcile_library(spark, args: argparse.Namespace) -> list[dict]:
    """Saved tracks, albums and artists of a user; fetched, stored and skipped items."""
    from mergewell.operators.persist import Store
    from mergewell.plans.engine import State
    from mergewell.plans.workflows import ingest_library
    from mergewell.sources import payloads

    kinds = {"tracks": payloads.SAVED_TRACKS, "albums": payloads.SAVED_ALBUMS, "artists": payloads.FOLLOWED_ARTISTS}
    pages = [payloads.read(spark, path, kind) if (path := getattr(args, name)) else spark.createDataFrame([], kind) for name, kind in kinds.items()]
    store = Store(spark, args.store)
    state = State.load(store)
    rows = payloads.library(*pages, tuple(getattr(args, f"max_{name}") for name in kinds))
    out, new, counts = ingest_library(rows, args.user_id, state, state.library_items)
    out.state.add("library_items", new).save(store)
    return [r.asDict() for r in counts.collect()]


def reconcile_releases(spark, args: argparse.Namespace) -> list[dict]:
    """Stored releases updated from landed metadata; the counters and what went to review. Without
    picks the candidates are chosen from the metadata, and each release sees what those before it
    wrote."""
    from mergewell.operators.persist import Store
    from mergewell.plans.engine import State
    from mergewell.plans.updates import update_in_order
    from mergewell.plans.workflows import update_releases
    from mergewell.sources import payloads
    from mergewell.sources.translate import release_graph

    store = Store(spark, args.store)
    graph = release_graph(payloads.read(spark, args.releases, payloads.METADATA_RELEASE))
    if not args.picks:
        run = update_in_order(store, graph, limit=args.limit)
        return [r.asDict() for df in (run.counters, run.review) for r in df.collect()]
    picks = payloads.read(spark, args.picks, "release_id string, requested string, resolved string")
    done = update_releases(State.load(store), picks, graph, limit=args.limit)
    done.outcome.state.save(store)
    return [r.asDict() for df in (done.outcome.counters, done.review) for r in df.collect()]


RECONCILE = {"lastfm": reconcile_scrobbles, "spotify": reconcile_library, "musicbrainz-releases": reconcile_releases}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "reconcile" and args.source == "lastfm":
            window(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("mergewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "reconcile":
            for row in RECONCILE[args.source](spark, args):
                print(row)
        else:
            from mergewell.operators.persist import Store
            from mergewell.plans.engine import State

            store = Store(spark, args.store)
            state = State.load(store)
            row = (str(uuid.uuid4()), args.display_name, args.email, args.spotify_user_id, args.lastfm_user)
            state.add("users", spark.createDataFrame([row], state.users.schema)).save(store)
            print(row[0])
    except Exception as e:  # the exit status is the report
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
