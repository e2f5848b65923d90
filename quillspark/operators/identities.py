"""Literals to redact, derived on the driver from addresses, remotes and branch names."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import literal_pattern, scrub_label
from ..functions.paths import POOLS, branch_of_label, normalize_project
from ..functions.words import STOPWORDS

# Words before a branch in folder names.
MARKERS = ["worktree", "worktrees", "workspace", "workspaces"]


def handles(address: str | None) -> list[str]:
    """The local part of an address and its pieces; a leading number and plus sign are no part of it."""
    local = re.sub(r"^\d+\+(?=.)", "", (address or "").partition("@")[0].strip())
    pieces = [p for p in re.split(r"[+._-]+", local) if p and not p.isdigit()]
    return list(dict.fromkeys([local, *pieces])) if local else []


def remote_owner(url: str | None) -> str | None:
    """The account of a git remote, by ssh (user@host:owner/name) or with a scheme."""
    found = re.match(r"(?:[a-z+]+://(?:[^/@]+@)?[^/]+/|[^/@:\s]+@[^/:\s]+:)([^/:\s]+)/", (url or "").strip(), re.I)
    return found[1] if found else None


def refused(literal: str, least: int, common: Iterable[str] = STOPWORDS) -> str | None:
    """Why a literal would mask ordinary text: too short, without letters, or a common word. None if it may be used."""
    low = literal.strip().lower()
    if len(low) < least:
        return "short"
    if not any(c.isalpha() for c in low):
        return "no letters"
    return "common word" if low in set(common) else None


def branch_terms(pairs: Iterable[tuple[str, str]], least: int = 6, common: Iterable[str] = STOPWORDS) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """(bare, decorated, refused) literals of (branch, repository) pairs. A compound needs five characters, a single word
    `least`; a stem that two branches of a repository share is a literal too."""
    by_repo: dict[str, set[str]] = defaultdict(set)
    for branch, repo in pairs:
        name = (branch or "").strip().strip("/").lower()
        if name and name not in ("worktrees", "workspaces"):
            by_repo[(repo or "").strip().lower()].add(name)
    names = set().union(*by_repo.values()) if by_repo else set()
    parts = {n: [p for p in re.split(r"[-_]+", n) if p] for n in names}
    wanted = {n: 5 if len(parts[n]) > 1 else least for n in names}
    for own in by_repo.values():
        shared: dict[str, int] = defaultdict(int)
        for n in own:
            for stem in {"-".join(parts[n][:i]) for i in range(1, len(parts[n]))}:
                shared[stem] += 1
        for stem, times in shared.items():
            if times > 1:
                wanted.setdefault(stem, least)
    verdicts = {n: refused(n, size, common) for n, size in wanted.items()}
    return sorted(n for n, v in verdicts.items() if v is None), sorted(f"{m}-{n}" for n in names for m in MARKERS), sorted((n, v) for n, v in verdicts.items() if v)


# --- what the driver's machine says ----------------------------------------------------------


def git_config(text: str | None) -> list[tuple[str, str, str, str]]:
    """(section, subsection, key, value) of a git configuration file; sections and keys lower-cased, comments and lines without = left out."""
    found, section, sub = [], "", ""
    for line in map(str.strip, (text or "").splitlines()):
        if head := re.match(r'\[\s*([^"\]]*?)\s*(?:"(.*)"\s*)?(?:\]|$)', line):
            section, sub = head[1].lower(), head[2] or ""
        elif line and line[0] not in "#;" and "=" in line:
            key, _, value = line.partition("=")
            found.append((section, sub, key.strip().lower(), value.strip().strip('"')))
    return found


def remote_owners(config: str | None) -> list[str]:
    """Accounts of the remotes in a repository's configuration, in its order."""
    owners = (remote_owner(v) for section, _, key, v in git_config(config) if (section, key) == ("remote", "url"))
    return list(dict.fromkeys(o for o in owners if o))


def user_literals(config: str | None) -> list[str]:
    """A user's name (whole, and its words) and the handles in their address."""
    out: list[str] = []
    for section, _, key, value in git_config(config):
        if (section, key) == ("user", "name") and value:
            out += [value, *value.split()]
        elif (section, key) == ("user", "email"):
            out += handles(value)
    return list(dict.fromkeys(out))


def derived(home: str, user_configs: Iterable[str] = (), repo_configs: Iterable[str] = (), personal: int = 2, inferred: int = 5) -> tuple[list[str], list[tuple[str, str]]]:
    """Literals that name a machine's owner, and those refused with the reason. What the user wrote of themselves may be shorter than
    what is inferred from the home folder and from remotes."""
    wanted: dict[str, int] = {}
    for literal in (x for c in user_configs for x in user_literals(c)):
        wanted.setdefault(literal.lower(), personal)
    for literal in [home.rstrip("/").rpartition("/")[2], *(o for c in repo_configs for o in remote_owners(c))]:
        if literal:
            wanted.setdefault(literal.lower(), inferred)
    verdicts = {x: refused(x, least) for x, least in wanted.items()}
    return sorted(x for x, v in verdicts.items() if v is None), sorted((x, v) for x, v in verdicts.items() if v)


def read_redact_file(path: str) -> list[str]:
    """Literals of a file, one a line; blank lines and those that begin with # say nothing. A missing file has none."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            lines = map(str.strip, f)
            return list(dict.fromkeys(x for x in lines if x and not x.startswith("#")))
    except OSError:
        return []


def read_sidecar(path: str) -> dict:
    """The document that documents.write_sidecar() wrote; empty if it is missing or is no JSON object."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def unmasked(document: str, literals: Iterable[str]) -> list[str]:
    """Literals that a finished document still shows at the beginning of a token: none, if masking did its work."""
    return sorted(x for x in set(literals) if (p := literal_pattern([x])) and re.search(p, document))


def decode_dash_path(name: str, is_dir: Callable[[str], bool] = os.path.isdir) -> str:
    """The path of a folder's name in which dashes stand for / and . alike, as far as the disk knows it: of the ways to read a
    prefix the one with the longest folder names that exist, level by level. The rest is read as paths.decoded_dashes() does."""
    parts = re.sub("-{2,}", "-.", name.strip("-")).split("-")
    if parts == [""]:
        return "unknown"
    at, here = 0, ""
    while at < len(parts):
        hidden = next((k for k in range(at + 1, len(parts)) if parts[k].startswith(".")), len(parts))  # where a hidden folder begins
        known = (k for k in range(hidden, at, -1) if is_dir(f"{here}/{'-'.join(parts[at:k])}"))
        if (to := next(known, None)) is None:
            break
        here, at = f"{here}/{'-'.join(parts[at:to])}", to
    while at < min(3, len(parts)):
        here, at = f"{here}/{parts[at]}", at + 1
    if at < len(parts):
        pool = rf"\.*(?:{'|'.join(POOLS)})"
        rest = re.sub(rf"(?i)-(?=\.|{pool}(?:-|$))", "/", "-".join(parts[at:]))
        here += "/" + re.sub(rf"(?i)((?:^|/){pool})-", r"\1/", rest)
    return here


def linked_worktree(folder: str, up: int = 6) -> tuple[str, str | None] | None:
    """(repository's folder, branch) of the linked worktree that a folder lies in, None for any other. Only .git files are read: the nearest one decides."""
    here = Path(folder)
    for place in [here, *here.parents][:up]:
        mark = place / ".git"
        if mark.is_dir():
            return None
        if mark.is_file():
            found = re.match(r"\s*gitdir:\s*(\S.*?)\s*$", mark.read_text(errors="replace").splitlines()[0] if mark.stat().st_size else "")
            admin = Path(os.path.normpath(place / found[1])) if found else None
            if admin is None or admin.parent.name != "worktrees" or admin.parent.parent.name != ".git":
                return None
            head = admin / "HEAD"
            branch = re.match(r"ref:\s*refs/heads/(\S+)", head.read_text(errors="replace")) if head.is_file() else None
            return str(admin.parent.parent.parent), branch[1] if branch else None
    return None


def worktree_labels(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """cwd, project, branch of folders on this machine that lie in linked worktrees beside their repository: a small table for joining to sessions by directory."""
    rows = [(f, Path(found[0]).name, found[1]) for f in sorted(set(folders)) if (found := linked_worktree(f))]
    return spark.createDataFrame(rows, "cwd string, project string, branch string")


def relabelled(events: DataFrame, branches: DataFrame, literals: Iterable[str] = ()) -> DataFrame:
    """Events with repaired project labels: worktree folders cut, a label that is a known branch (branch, repo) given its repository, and others that hold a literal masked."""
    known = branches.where("repo <> ''").groupBy(F.lower("branch").alias("_label")).agg(F.min("repo").alias("_repo"))
    own = events.withColumn("project", normalize_project(F.col("project"))).withColumn("_label", F.lower("project"))
    label = F.coalesce("_repo", scrub_label(F.col("project"), literals))
    return own.join(F.broadcast(known), "_label", "left").withColumn("project", label).drop("_label", "_repo")  # branches: of one machine


#: What a redaction sidecar holds.
BUCKETS = ("identities", "branches", "decorated", "explicit")


def redaction(branches: Iterable[tuple[str, str]], sidecar: dict | None = None, explicit: Iterable[str] = (), mode: str = "full") -> tuple[list[str], dict[str, list[str]]]:
    """All literals to mask, and by bucket: what a run found itself joined with what an earlier run wrote down. mode: full masks
    branch names bare and decorated, decorated only the latter, off neither; identities and explicit literals always."""
    if mode not in ("full", "decorated", "off"):
        raise ValueError(f"no branch mode: {mode}")
    old = {k: [x for x in (sidecar or {}).get(k, []) if isinstance(x, str)] if isinstance((sidecar or {}).get(k, []), list) else [] for k in BUCKETS}
    pairs = (sidecar or {}).get("branch_repos")
    pairs = [*branches, *((b, r) for b, r in (pairs.items() if isinstance(pairs, dict) else ()) if isinstance(b, str) and isinstance(r, str))]
    bare, decorated, _ = branch_terms(pairs)
    found = {"identities": old["identities"], "branches": [*bare, *old["branches"]] if mode == "full" else [], "decorated": [*decorated, *old["decorated"]] if mode != "off" else [], "explicit": [*explicit, *old["explicit"]]}
    found = {k: sorted({x.strip().lower() for x in v if x.strip()}) for k, v in found.items()}
    return sorted(set().union(*found.values())), found


def project_labels(events: DataFrame) -> DataFrame:
    """label, branch, repo: each label of a corpus as it is spelled, and what an old label says of a branch."""
    own = events.select(F.col("project").alias("label")).where("label <> ''").distinct()
    repo = normalize_project(F.col("label"))
    return own.select("label", branch_of_label(F.col("label")).alias("branch"), F.when(branch_of_label(F.col("label")).isNotNull() & (repo != "unknown"), F.lower(repo)).alias("repo"))


def account_names(home: str, user: str = "", extra: Iterable[str] = ()) -> list[str]:
    """Names of a machine's owner that terms are searched for: the login, the home folder's name and others given, of three letters or more."""
    names = {x.strip().lower() for x in (user, home.rstrip("/").rpartition("/")[2], *extra) if x}
    return sorted(n for n in names if len(n) >= 3)


def repository_configs(folders: Iterable[str], up: int = 6, most: int = 120) -> list[str]:
    """Configurations of the distinct repositories that folders on this machine lie in, at most `most`: the nearest real .git folder above each. Linked worktrees are passed over, since their repository has the same remotes."""
    roots: dict[Path, None] = {}
    for folder in sorted(set(folders)):
        here = Path(folder)
        root = next((p for p in [here, *here.parents][:up] if (p / ".git").is_dir()), None)
        if root is not None:
            roots.setdefault(root)
    found = (r / ".git" / "config" for r in list(roots)[:most])
    return [f.read_text(encoding="utf-8", errors="replace") for f in found if f.is_file()]
