"""Corpus services: chunk tables and their manifests, memories, notes' rules, fetching of linked PDFs, job records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions import text as X
from quillmere.operators import retrieval

PDF_COLUMNS = ("id", "text", "source_path", "source_file", "page", "page_label", "parser", "title", "authors", "year", "section", "section_level", "section_path", "block_kind", "chunk_kind", "block_count", "chunk_index", "char_count", "word_count")
MEMORY = T.StructType([T.StructField(c, T.StringType()) for c in ("session_id", "created_at", "query", "summary", "final_answer")])
JOB = T.StructType([T.StructField(c, T.StringType()) for c in ("job_id", "status", "label", "created_at", "started_at", "finished_at", "error", "stdout_path", "stderr_path")] + [T.StructField("command", T.ArrayType(T.StringType())), T.StructField("returncode", T.IntegerType())])


def latest(chunks: DataFrame, id_col: str = "id", order: str = "indexed_at") -> DataFrame:
    """One row for each chunk: that which was indexed last, of several such the one with the least hash of its values."""
    last = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc_nulls_last(order), F.xxhash64(*chunks.columns)))
    return chunks.withColumn("_last", last).filter("_last = 1").drop("_last")


def write_chunks(chunks: DataFrame, path: str, replace: bool = True) -> None:
    """Write a chunk table and, beside it, its full-text index, both clustered for reading by term or id."""
    chunks.write.mode("overwrite" if replace else "errorifexists").parquet(f"{path}/chunks")
    post, lengths = retrieval.postings(chunks, "id", "text")
    post.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and files, and average, least and most characters and words."""
    number = lambda c: [F.round(F.avg(c), 2).alias(f"avg_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return chunks.agg(F.count("*").alias("chunk_count"), F.count_distinct("source_path").alias("file_count"), *number("char_count"), *number("word_count"))


def kinds(chunks: DataFrame, *columns: str) -> DataFrame:
    """Counts by value of each of some columns: what, value, count; in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    return chunks.select(pairs.alias("p")).groupBy("p.what", "p.value").count()


def write_manifest(chunks: DataFrame, path: str, **settings: object) -> dict:
    """A JSON file that describes an index; also returned."""
    row = statistics(chunks).first().asDict()
    counts = {}
    for r in kinds(chunks, "chunk_kind", "block_kind", "parser").collect():
        counts.setdefault(r["what"], {})[r["value"]] = r["count"]
    manifest = {"created_at": datetime.now(UTC).isoformat(), **settings, **row, "counts": counts}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest, ensure_ascii=False, indent=2, default=str))
    return manifest


def point_to(root: str, index: str, default: str | None = None) -> None:
    """Make `index` the active one below `root`; the default index needs no pointer."""
    pointer = Path(root) / "active_index.json"
    if index == (default or root):
        pointer.unlink(missing_ok=True)
    else:
        pointer.parent.mkdir(parents=True, exist_ok=True)
        pointer.write_text(json.dumps({"index_root": index, "table": f"{index}/chunks", "manifest_path": f"{index}/manifest.json"}))


def active(root: str) -> str:
    """The active index below `root`."""
    pointer = Path(root) / "active_index.json"
    return json.loads(pointer.read_text())["index_root"] if pointer.exists() else root


def health(spark: SparkSession, root: str, probe: str = "the", k: int = 3, timeout: float = 10.0, retries: int = 1) -> dict:
    """Whether the active index can be read and searched: status (ok, missing, error, timeout), row_count, hits, attempts. A
    probe that takes longer than `timeout` seconds is cancelled, and tried again `retries` times."""
    where, none = active(root), {"row_count": 0, "hits": []}
    if not exists(spark, f"{where}/chunks"):
        return {"status": "missing", **none, "attempts": 0}
    for attempt in range(1, retries + 2):
        got: dict = {}
        group = f"health-{uuid.uuid4().hex}"

        def look(got: dict = got, group: str = group) -> None:
            spark.sparkContext.setJobGroup(group, "index health", True)
            try:
                rows = spark.read.parquet(f"{where}/chunks")
                got |= {"status": "ok", "row_count": rows.count(), "hits": [r.asDict() for r in retrieval.bm25(rows, "id", "text", probe, k).collect()]}
            except Exception as e:  # noqa: BLE001
                got |= {"status": "error", **none, "error": str(e)[:500]}

        worker = InheritableThread(target=look, daemon=True)
        worker.start()
        worker.join(timeout)
        if not worker.is_alive() and got:
            return {**got, "attempts": attempt}
        spark.sparkContext.cancelJobGroup(group)
    return {"status": "timeout", **none, "attempts": retries + 1}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a path in whatever file system it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path and all below it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save_json(path: str, record: dict) -> None:
    """Keep a record: a fetch's outcome, a session, an experiment."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(record, ensure_ascii=False, indent=2, default=str))


def write_fetch_manifest(fetched: DataFrame, path: str, limit: int = 100_000) -> dict:
    """What became of linked PDFs (url, status, attempts), up to `limit` of them, and their counts; kept and returned."""
    rows = fetched.orderBy("url").limit(limit).collect()
    counts = {r.status: r["count"] for r in status_counts(fetched).collect()}
    manifest = {"created_at": datetime.now(UTC).isoformat(), "counts": counts, "records": [r.asDict() for r in rows]}
    save_json(path, manifest)
    return manifest


def job(root: str, job_id: str) -> dict:
    """A job's record with what it wrote: stdout and stderr where there are such files."""
    record = json.loads((Path(root) / job_id / "job.json").read_text())
    for name in ("stdout", "stderr"):
        file = Path(record.get(f"{name}_path") or Path(root) / job_id / f"{name}.log")
        record[name] = file.read_text(errors="replace") if file.exists() else ""
    return record


def recall(memories: DataFrame, query: str, k: int = 3, seq: str = "seq") -> DataFrame:
    """Memories that share terms with a query, those with most first, then in their order: session_id, overlap, rank."""
    asked = X.memory_tokens(F.lit(query))
    held = X.memory_tokens(F.concat_ws(" ", "query", "summary", "final_answer", "session_id"))
    hits = memories.select("session_id", seq, F.size(F.array_intersect(held, asked)).alias("overlap")).filter("overlap > 0").orderBy(F.desc("overlap"), seq).limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overlap"), seq))).drop(seq)


def append_memory(spark: SparkSession, path: str, rows: list[dict]) -> None:
    spark.createDataFrame([tuple(r.get(c) for c in MEMORY.fieldNames()) for r in rows], MEMORY).coalesce(1).write.mode("append").json(path)


def load_memories(spark: SparkSession, path: str) -> DataFrame:
    """All memories of a folder; a line that is no JSON fails the read."""
    return spark.read.schema(MEMORY).option("mode", "FAILFAST").json(path)


#: What a note's header must hold: keys, the breadcrumbs and the counterpart's marks by branch.
HEADER_KEYS = ("cssclasses", "tags")
CRUMBS = {"EN": r"\[\[Home", "UA": r"\[\[UA/Головна", "root": r"\[\[Home|\[\[UA/Головна"}
COUNTERPARTS = {"EN": "🇺🇦 [[", "UA": "🇬🇧 [["}


def note_issues(notes: DataFrame, path: str = "path", text: str = "text", keys: tuple[str, ...] = HEADER_KEYS) -> DataFrame:
    """What is wrong with notes, an issue a row: path, issue. The breadcrumb is the second line of a note's body."""
    head, body = X.frontmatter(F.col(text)), X.without_frontmatter(F.col(text))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    second = F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))
    branch, has = X.branch(F.col(path)), F.col(text).startswith("---\n")
    checks = [F.when(~has, "missing_frontmatter")]
    checks += [F.when(has & ~head.rlike(rf"(?m)^{k}\s*:"), f"missing_frontmatter_{k}") for k in keys]
    checks += [F.when(~body.rlike(r"(?m)^#\s+\S"), "missing_title")]
    checks += [F.when((branch == b) & ~second.rlike(crumb), "missing_breadcrumb") for b, crumb in CRUMBS.items()]
    checks += [F.when((branch == b) & ~F.contains(F.col(text), F.lit(mark)), "missing_counterpart_link") for b, mark in COUNTERPARTS.items()]
    return notes.filter(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def listed_notes(notes: DataFrame, branch: str | None = None, contains: str | None = None, limit: int = 200) -> DataFrame:
    """Notes by the parts of their paths: path, title, branch; of a branch, or with a string in path or title."""
    rows = notes.select("path", "title", X.branch(F.col("path")).alias("branch"))
    if branch:
        rows = rows.filter(F.col("branch") == branch)
    if contains:
        rows = rows.filter(F.contains(F.lower(F.concat_ws("\n", "path", "title")), F.lit(contains.lower())))
    return rows.orderBy(F.split("path", "/")).limit(limit)


def note_path(root: str, path: str, excluded: tuple[str, ...] = (".git", ".obsidian", "PDF")) -> Path:
    """A note's file below `root`; ValueError for paths that are empty, absolute, lead out, or are no notes."""
    parts = Path(path).parts
    if not path or Path(path).is_absolute() or ".." in parts or not path.endswith(".md") or parts[0] in excluded:
        raise ValueError(f"no path of a note: {path!r}")
    return Path(root) / path


def write_note(root: str, path: str, content: str, mode: str = "overwrite", create: bool = True) -> Path:
    """Write, append to or prepend to a note. New ones are only made below EN/ and UA/."""
    file = note_path(root, path)
    if not file.exists() and (not create or Path(path).parts[0] not in ("EN", "UA")):
        raise ValueError(f"no such note: {path}")
    old = file.read_text() if file.exists() else ""
    new = {"overwrite": content, "append": old + content, "prepend": content.rstrip("\n") + "\n" + old}[mode]
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(new if new.endswith("\n") else new + "\n")
    return file


def write_mirror(root: str, path: str, mirror: str, overwrite: bool = False) -> Path:
    """A note in the other branch that links back to this one."""
    ends = {Path(path).parts[0], Path(mirror).parts[0]}
    if ends != {"EN", "UA"}:
        raise ValueError("mirrors lie in EN/ and UA/")
    if note_path(root, mirror).exists() and not overwrite:
        raise ValueError(f"there is a note already: {mirror}")
    icon, name = {"EN": ("🇬🇧", "English"), "UA": ("🇺🇦", "Українська")}[Path(path).parts[0]]
    back = f"{icon} [[{path}|{name}]]"
    text = note_path(root, path).read_text()
    lines = text.split("\n")
    if len(lines) > 2 and lines[0].startswith("# ") and lines[2].startswith(("🌐 [[", "🇺🇦 [[", "🇬🇧 [[")):
        lines[2] = back
        return write_note(root, mirror, "\n".join(lines))
    return write_note(root, mirror, text.rstrip("\n") + f"\n\n{back}\n")


def read_note(root: str, path: str) -> dict:
    """A note: path, branch, title (its first line of level 1, else the file's stem), content."""
    text = note_path(root, path).read_text()
    title = next((x[2:].strip() for x in text.split("\n") if x.startswith("# ")), Path(path).stem)
    branch = Path(path).parts[0] if Path(path).parts[0] in ("EN", "UA") else "root"
    return {"path": path, "language_branch": branch, "title": title, "content": text}


def linked_pdfs(notes: DataFrame, path: str = "path", text: str = "text", limit: int | None = None) -> DataFrame:
    """Addresses in notes with their candidates: url, notes (sorted), candidates, file_name; the first `limit` by note."""
    found = notes.filter(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.posexplode(X.urls(F.col(text))).alias("at", "url"))
    rows = found.groupBy("url").agg(F.sort_array(F.collect_set("path")).alias("notes"), F.min(F.struct("path", "at")).alias("_first"))
    if limit is not None:
        rows = rows.orderBy("_first").limit(limit)
    return rows.select("url", "notes", X.pdf_candidates(F.col("url")).alias("candidates"), X.pdf_file_name(F.lit(None).cast("string"), F.col("url")).alias("file_name"))


def fetch(found: DataFrame, get: Callable[[str], tuple[bytes, str, str]] | None, folder: str, dry_run: bool = False) -> DataFrame:
    """Fetch linked PDFs on the workers: url, status (exists, downloadable, downloaded, failed), attempts. `get` returns a
    response's bytes, content type and disposition; pages that are no PDF are searched for addresses of one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, candidates, name in zip(batch["url"], batch["candidates"], batch["file_name"], strict=True):
                target = Path(folder) / name
                if target.exists():
                    out.append((url, "exists", 0))
                    continue
                queue, seen, status = list(candidates), set(), "failed"
                while queue and status == "failed":
                    link = queue.pop(0)
                    if link in seen:
                        continue
                    seen.add(link)
                    try:
                        body, kind, _ = get(link)
                    except Exception:  # noqa: BLE001
                        continue
                    if body[:5] == b"%PDF-" or "application/pdf" in (kind or ""):
                        status = "downloadable" if dry_run else "downloaded"
                        if not dry_run:
                            target.parent.mkdir(parents=True, exist_ok=True)
                            target.write_bytes(body)
                    elif len(body) <= 1 << 20:
                        queue += pdf_links(body.decode("utf-8", "replace"), link)
                out.append((url, status, len(seen)))
            yield pd.DataFrame(out, columns=["url", "status", "attempts"])

    return found.select("url", "candidates", "file_name").mapInPandas(run, "url string, status string, attempts int")


def pdf_links(html: str, base: str) -> list[str]:
    """Addresses of PDFs in a page: those its meta data name, then links that end in .pdf or have pdf in their path."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    found: list[str] = []

    class Parser(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
            a = {k: v or "" for k, v in attrs}
            if tag == "meta" and (a.get("name", "").lower() in ("citation_pdf_url", "dc.identifier") or a.get("property", "").startswith("og:")) and (a.get("name", "").lower() == "citation_pdf_url" or ".pdf" in a.get("content", "").lower()):
                found.append(urljoin(base, a.get("content", "")))
            elif "pdf" in a.get("href", "").lower():
                found.append(urljoin(base, a["href"]))

    Parser().feed(html)
    return list(dict.fromkeys(found))


def status_counts(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("status").count()


def save_job(root: str, job_id: str | None = None, **fields: object) -> dict:
    """Make or update a job's record."""
    job_id = job_id or uuid.uuid4().hex
    file = Path(root) / job_id / "job.json"
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    record = json.loads(file.read_text()) if file.exists() else {"job_id": job_id, "status": "queued", "created_at": now}
    record |= fields
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(record, sort_keys=True))
    return record


def jobs(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """The newest jobs; files that are no JSON are skipped."""
    return spark.read.schema(JOB).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "job.json").json(root).filter("job_id IS NOT NULL").orderBy(F.desc("created_at"), "job_id").limit(limit)


def embed(rows: DataFrame, text_col: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """Rows with a `vector` column from an embedder of texts, called on batches on the workers."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = series.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])])

    return rows.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(text_col)))


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedder that needs no model: word counts by hash, signed, of unit length."""
    import zlib

    def embedder(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embedder


def bundle(query: str, retrievers: dict[str, Callable[[], DataFrame]]) -> dict:
    """What several retrievers find for a query; those that fail give a warning instead of rows."""
    out: dict = {"query": query, "warnings": [], "created_at": datetime.now(UTC).isoformat()}
    for name, make in retrievers.items():
        rows, warnings = retrieval.degrade([(name, make)])
        out[name] = [r.asDict() for r in rows]
        out["warnings"] += warnings
    out["summary"] = ", ".join(f"{len(out[n])} {n}" for n in retrievers)
    return out

