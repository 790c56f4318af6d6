"""Tickets of issue trackers as records: their text, the map they belong to, ids, remotes and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a ticket names its map and what blocks it, and what an answer of a forge says of an error.
MAP_REF = r"(?dm)^Map:\s*#(\d+)\s*$"
BOOKKEEPING = r"(?dm)^(?:Map|Blocked by):\s*#\d+\s*$\n?"
AUTH = ("401", "403", "unauthorized", "bad credentials", "forbidden")
GONE = ("404", "not found")
BLANKS = " \t\n\r\f\v"


def _strip(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def ticket_text(title: Column, body: Column, resolution: Column) -> Column:
    """Title, body without the lines that only keep books, and resolution, as paragraphs; empty ones are left out, and
    nulls are empty."""
    kept = _strip(F.regexp_replace(F.coalesce(body, F.lit("")), BOOKKEEPING, ""))
    parts = [F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), kept, _strip(resolution)]
    return F.concat_ws("\n\n", *(F.when(p != "", p) for p in parts))


def map_ref(body: Column) -> Column:
    """The number of the first map that the body names; null without one."""
    found = F.regexp_extract(F.coalesce(body, F.lit("")), MAP_REF, 1)
    return F.when(found != "", found.cast("long"))


def repo_domain(repo: Column) -> Column:
    """The domain of a repository's records: its last part, in lower case, with underscores."""
    return F.translate(F.lower(F.element_at(F.split(repo, "/"), -1)), "- ", "__")


def ticket_id(domain: Column, url: Column) -> Column:
    return F.concat(F.lit("drawer_"), domain, F.lit("_decisions_"), F.substring(F.sha2(url, 256), 1, 24))


def remote_repo(url: Column, hosts: tuple[str, ...] = ()) -> Column:
    """(forge, repo) of a git remote; null without a known forge, or with fewer than two parts. ``hosts`` are those of
    self-hosted forges; their ports don't count."""
    clean = F.regexp_replace(_strip(url), r"\.git\z", "")
    parts = F.filter(F.split(clean, "[:/]+"), lambda p: p != "")
    own = [clean.contains(h.split(":")[0]) for h in hosts if h.split(":")[0]]
    forge = F.when(clean.contains("github.com"), "github").when(F.greatest(F.lit(False), F.lit(False), *own), "gitea")
    repo = F.array_join(F.slice(parts, -2, 2), "/")
    return F.when(forge.isNotNull() & (F.size(parts) >= 2), F.struct(forge.alias("forge"), repo.alias("repo")))


def forge_error(said: Column) -> Column:
    """'auth', 'gone' or 'transient', by what a forge said."""
    low = F.lower(F.coalesce(said, F.lit("")))
    any_of = lambda marks: F.greatest(F.lit(False), *(low.contains(m) for m in marks))
    return F.when(any_of(AUTH), "auth").when(any_of(GONE), "gone").otherwise("transient")
