"""The registered queries again as SQL over the given tables, for the comparison in DuckDB."""

from __future__ import annotations

import re

from rulelens.functions.verdicts import PARSE_ERROR
from rulelens.operators.evaluation import ADJUDICATION
from rulelens.sources.views import MODEL, STRATEGY


def _name(no: str) -> str:
    return f"concat('org', ({no}) // 4, '/repo', {no})"


_EXT = "case lang when 'en' then '.py' when 'fr' then '.js' when 'de' then '.go' else '.md' end"
_NEXT = "case l_returnflag when 'N' then 'A' when 'A' then 'R' else 'N' end"


def _verdict(c: str) -> str:
    return f"case {c} when 'N' then 'pass' when 'A' then 'partial' else 'fail' end"


def _windows(source: str, size: int, overlap: int) -> str:
    """Fixed windows of ``source(repo, file_path, content)`` with their lines."""
    step = size - overlap
    return f"""
    select repo, file_path, i as chunk_no, substr(content, 1 + i * {step}, {size}) as chunk,
      1 + length(left(content, i * {step})) - length(replace(left(content, i * {step}), chr(10), '')) as start_line
    from (select *, unnest(range(0, greatest(1, cast(ceil((length(content) - {overlap}) / {step}.0) as bigint)))) as i
          from {source} where length(content) > 0)
    """


VIEWS = {
    "tasks": f"""
      select id, user_id, repo_no, concat('https://github.com/', repository_full_name, '.git') as repository_url,
        repository_full_name, pr_author, pr_number, concat('sha', id) as pr_head_sha,
        case when pr_number is null then null else concat('branch-', pr_number) end as pr_head_ref,
        status, created_at, retry_count,
        case status when 'completed' then 100 when 'running' then id % 100 else 0 end as progress,
        case status when 'completed' then 'Done' when 'running' then concat('step ', id % 100) else '' end as progress_message,
        case when status = 'pending' and id % 4 = 0 then created_at + interval 120 second end as retry_after,
        case when status <> 'pending' then created_at + interval 1 second end as started_at,
        case when status in ('completed', 'failed') then created_at + to_seconds(id % 300) end as completed_at,
        case when status <> 'failed' then null
          when id % 4 = 0 then concat('{{"code":"LLM_UNAVAILABLE","message":"no answer for ', id, '","technical":"timeout"}}')
          when id % 4 = 1 then '{{"detail": 1}}'
          when id % 4 = 2 then concat('{{"code":"OTHER","message":"m', id, '"}}')
          else concat('plain failure ', id) end as error,
        id % 3 <> 0 as enable_cross_check,
        status = 'completed' and id % 10 <> 9 as has_result
      from (select o_orderkey as id, o_custkey // 75 as repo_no, (o_custkey // 75) // 4 as user_id,
          {_name('o_custkey // 75')} as repository_full_name,
          case when o_custkey % 11 = 0 then null when o_custkey % 13 = 0 then '' else concat('dev', o_custkey % 37) end as pr_author,
          case when o_custkey % 11 = 0 then null else o_orderkey % 50 end as pr_number,
          case o_orderstatus when 'F' then 'failed' when 'O' then 'completed'
            else case when o_orderkey % 2 = 0 then 'pending' else 'running' end end as status,
          o_orderdate as created_at, o_orderkey % 7 as retry_count from orders)""",
    "users": "select distinct (c_custkey // 75) // 4 as user_id, concat('user', (c_custkey // 75) // 4) as login from customer",
    "rules": f"""
      select p_partkey as id, (p_partkey // 100) // 4 + case when p_size % 10 = 0 then 1 else 0 end as user_id,
        p_partkey // 100 as repo_no, {_name('p_partkey // 100')} as repository_full_name,
        concat('Check ', p_name, ' of ', p_brand, ' ', p_type) as rule_text, p_partkey % 100 as position,
        case when p_size % 7 = 0 then null else p_size % 4 <> 0 end as enabled,
        timestamp '2020-01-01 00:00:00' + to_hours(p_partkey * 37 % 1000) as created_at, p_size
      from part""",
    "config_requests": f"""
      select s_suppkey as version, (s_suppkey // 5) // 4 as user_id, s_suppkey // 5 as repo_no,
        {_name('s_suppkey // 5')} as repository_full_name, s_suppkey % 25 as max_evaluations_per_pr,
        (s_suppkey % 13) / 10.0::double as approval_threshold, s_suppkey % 2 = 0 as enable_cross_check,
        s_suppkey % 23 as max_chunks_per_rule,
        case s_suppkey % 4 when 0 then null when 1 then 'azure/gpt-4o' when 2 then 'gemini-2.5-flash' else 'unknown-model' end as llm_model,
        case s_suppkey % 5 when 0 then null when 1 then 'azure/gpt-4.1' when 2 then 'no-such' else 'azure/o4-mini' end as llm_primary_model,
        case s_suppkey % 6 when 0 then null when 1 then '' else 'azure/gpt-4o' end as llm_secondary_model,
        s_acctbal as balance from supplier""",
    "repo_configs": """
      select user_id, repository_full_name, repo_no, 1 + version % 4 as max_evaluations_per_pr,
        0.5::double + (repo_no % 5) / 10.0::double as approval_threshold, enable_cross_check,
        repo_no % 3 <> 0 as pr_evaluation_enabled, 1 + repo_no % 20 as max_chunks_per_rule,
        case when repo_no % 2 = 0 then null else 'azure/gpt-4o' end as llm_model,
        case when repo_no % 3 = 0 then 'azure/gpt-4.1' end as llm_primary_model,
        case when repo_no % 3 = 1 then 'azure/o4-mini' end as llm_secondary_model
      from (select *, row_number() over (partition by user_id, repository_full_name order by version desc) as rn from config_requests)
      where rn = 1 and balance >= 2000""",
    "task_viewers": "select distinct l_orderkey as task_id, l_suppkey % 5 as user_id from lineitem where l_returnflag = 'R'",
    "lines": f"""
      select l_orderkey as task_id, concat('Rule ', l_partkey) as rule, {_verdict('l_returnflag')} as primary_verdict,
        {_verdict(f"(case when l_linestatus = 'F' then l_returnflag else {_NEXT} end)")} as secondary_verdict,
        case when l_partkey % 3 = 0 then null else 'pass' end as adjudicated_verdict,
        case when l_quantity < 5 then '' else concat('Line ', l_linenumber, ' of order ', l_orderkey, '. Supplier ', l_suppkey, ' checked. End') end as explanation,
        cast(floor(l_quantity) as bigint) * 10 as tokens_used, l_linestatus, l_tax,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 as rule_idx
      from lineitem""",
    "final": """
      select *, case when primary_verdict = secondary_verdict then primary_verdict
          when adjudicated_verdict is not null then adjudicated_verdict
          when (case secondary_verdict when 'pass' then 0 when 'partial' then 1 else 2 end)
             > (case primary_verdict when 'pass' then 0 when 'partial' then 1 else 2 end) then secondary_verdict
          else primary_verdict end as final_verdict,
        primary_verdict = secondary_verdict as agreement,
        primary_verdict <> secondary_verdict and adjudicated_verdict is not null as discriminator_used
      from lines""",
    "repositories": f"""
      select id, concat('https://github.com/', {_name('id')}, '.git') as url, {_name('id')} as full_name
      from (select distinct c_custkey // 75 as id from customer)""",
    "indexed": f"""
      select id * 2 as id, id as repository_id, url, md5(concat(url, '|{MODEL}|{STRATEGY}')) as collection_name, full_name
      from repositories""",
    "stored_files": f"""
      select source as repo, concat('src/', lang, '/', doc_id, {_EXT}) as file_path, text as content from documents
      union all select concat('src', page_id // 13), concat('pages/', page_id, '.html'), html from pages""",
    "current_files": f"""
      select source as repo, concat('src/', lang, '/', documents.doc_id, {_EXT}) as file_path,
        case when labels.quality = 1 then concat(text, chr(10), '# v2') else text end as content
      from documents left join labels on labels.doc_id = documents.doc_id
      union all select concat('src', item_id // 2), concat('bench/', item_id, '.txt'), text from benchmark""",
    "changes": """
      select coalesce(c.repo, s.repo) as repo, coalesce(c.file_path, s.file_path) as file_path,
        case when s.file_path is null then 'new' when c.file_path is null then 'deleted'
          when sha256(c.content) <> sha256(s.content) then 'changed' else 'unchanged' end as change
      from current_files c full outer join stored_files s on c.repo = s.repo and c.file_path = s.file_path""",
    "code": """
      select concat('repo', p_partkey // 100) as repo, p_partkey as k, replace(p_name, ' ', '_') as name,
        concat('src/', replace(p_name, ' ', '_'), '/f', p_partkey, case p_partkey % 3 when 0 then '.py' when 1 then '.go' else '.java' end) as file_path,
        case p_partkey % 3 when 0 then length(concat('import os', chr(10), chr(10), 'class C', p_partkey, ':', chr(10), '    def ', p_name, '(self, a):', chr(10), '        return ', p_size, chr(10), chr(10), '    def second(self):', chr(10), '        pass', chr(10), chr(10), 'def top_', p_name, '(x):', chr(10), '    return x', chr(10)))
          when 1 then length(concat('package main', chr(10), chr(10), 'type T', p_partkey, ' struct {', chr(10), '.n int', chr(10), '}', chr(10), chr(10), 'func (t *T', p_partkey, ') ', p_name, '() int {', chr(10), '.return ', p_size, chr(10), '}', chr(10), chr(10), 'func top_', p_name, '() {', chr(10), '}', chr(10)))
          else length(concat('package app;', chr(10), chr(10), 'public class C', p_partkey, ' {', chr(10), '    public int ', p_name, '(int a) {', chr(10), '        return ', p_size, ';', chr(10), '    }', chr(10), '}', chr(10))) end as length
      from part""",
    "decl": """
      select repo, file_path, kind, node_type, decl, first, last, depth, signature from (
        select repo, file_path, unnest(case k % 3
          when 0 then [
            {kind: 'class', node_type: 'class_definition', decl: concat('C', k), first: 3, last: 8, depth: 0, signature: ''},
            {kind: 'method', node_type: 'function_definition', decl: name, first: 4, last: 5, depth: 1, signature: '(self, a)'},
            {kind: 'method', node_type: 'function_definition', decl: 'second', first: 7, last: 8, depth: 1, signature: '(self)'},
            {kind: 'function', node_type: 'function_definition', decl: concat('top_', name), first: 10, last: 11, depth: 0, signature: '(x)'}]
          when 1 then [
            {kind: 'type', node_type: 'type_declaration', decl: concat('T', k), first: 3, last: 5, depth: 0, signature: ''},
            {kind: 'method', node_type: 'method_declaration', decl: name, first: 7, last: 9, depth: 0, signature: ''},
            {kind: 'function', node_type: 'function_declaration', decl: concat('top_', name), first: 11, last: 12, depth: 0, signature: ''}]
          else [
            {kind: 'class', node_type: 'class_declaration', decl: concat('C', k), first: 3, last: 7, depth: 0, signature: ''},
            {kind: 'method', node_type: 'method_declaration', decl: name, first: 4, last: 6, depth: 1, signature: ''}]
          end, recursive := true) from code)""",
    "chunks": """
      select vec_id, concat('c', label) as collection_name, case when vec_id % 4 = 0 then 'pr-1' else '' end as branch,
        concat('f', vec_id % 60) as source, vec_id % 100 as start_line, vec_id % 100 + 20 as end_line,
        case vec_id % 3 when 0 then 'python' when 1 then 'javascript' end as language,
        case vec_id % 2 when 0 then 'function_definition' else 'fallback_text_split' end as node_type,
        case when vec_id % 4 < 3 then concat('fn', vec_id % 7) end as node_name,
        concat('chunk ', vec_id) as content, md5(cast(vec_id as varchar)) as chunk_hash, embedding::double[] as vec
      from embeddings""",
    "slots": """
      select *, row_number() over (partition by repository_full_name order by position, id) as slot from rules
      qualify slot <= 10""",
    "asked": """
      select *, row_number() over (partition by repository_full_name order by position, id) - 1 as rule_idx from rules
      where coalesce(enabled, true)""",
    "features": """
      select id, slot, count(*) as n from (
        select id, cast(('0x' || substr(md5(lower(word)), 1, 8)) as bigint) % 64 as slot
        from (select id, unnest(regexp_extract_all(rule_text, '[A-Za-z0-9_]+')) as word from rules))
      group by id, slot""",
    "rule_vectors": """
      select id, slot, (n / sqrt(sum(n * n) over (partition by id)))::float as value from features""",
    "queries": """
      select s.id as query_id, concat('c', s.repo_no % 10) as collection_name,
        list(coalesce(f.value, 0)::double order by d.slot) as qvec
      from asked s cross join (select unnest(range(64)) as slot) d
      left join rule_vectors f on f.id = s.id and f.slot = d.slot
      group by s.id, s.repo_no""",
    "pairs": """
      select q.query_id, c.* exclude (vec), round(list_cosine_similarity(q.qvec, c.vec), 9) as similarity
      from queries q join chunks c on c.collection_name = q.collection_name""",
    "hits": """
      select *, row_number() over (partition by query_id order by similarity desc, chunk_hash) as hit_no from pairs
      where branch = '' qualify hit_no <= 20""",
    "good_hits": "select * from hits where similarity >= 0",
    "context_files": """
      select concat('f', doc_id) as source, text as file_text from documents
      where doc_id not in (select doc_id from labels where toxic = 1)""",
    "grouped": """
      select g.*, f.file_text is not null as found, coalesce(f.file_text, g.chunk_text) as file_text from (
        select query_id, source, round(max(similarity), 4) as relevance_score, min(hit_no) as first_hit,
          arg_min(language, hit_no) filter (where language is not null) as language,
          string_agg(content, chr(10) order by hit_no) as chunk_text, count(*) as hits
        from good_hits group by query_id, source) g
      left join context_files f on f.source = g.source""",
    "symbol_lists": """
      select query_id, source, string_agg(node_name, ',' order by first_no) as symbols,
        string_agg(node_name, ', ' order by first_no) as shown, count(*) as n
      from (select query_id, source, node_name, min(hit_no) as first_no from good_hits where node_name is not null
            group by query_id, source, node_name) group by query_id, source""",
    "scored": """
      select t.id as task_id, t.user_id, t.repository_full_name, coalesce(p.rules, 0) as rules,
        p.points / p.rules as ui_score, coalesce(p.points / p.rules, 0.0) as score
      from tasks t left join (
        select task_id, count(*) as rules, sum(case final_verdict when 'pass' then 1.0::double when 'partial' then 0.5::double else 0.0::double end) as points
        from final group by task_id) p on p.task_id = t.id
      where t.status = 'completed'""",
    "approved": """
      select s.*, coalesce(c.approval_threshold, 0.8::double) as approval_threshold,
        s.score >= coalesce(c.approval_threshold, 0.8::double) as approved, cast(floor(s.score * 100) as bigint) as pct
      from scored s left join repo_configs c on c.user_id = s.user_id and c.repository_full_name = s.repository_full_name""",
    "repo_stats": """
      select user_id, pr_author, repository_full_name, count(*) as total_submissions,
        count(*) filter (where status = 'completed') as completed_submissions, max(created_at) as last_submitted_at,
        arg_max(id, (created_at, id)) filter (where has_result) as best_task_id,
        arg_max({n: pr_number}, (created_at, id)) filter (where has_result) as best
      from tasks where pr_author is not null group by all""",
    "primary_counts": """
      select task_id, count(*) filter (where primary_verdict = 'pass') as pass_count,
        count(*) filter (where primary_verdict = 'partial') as partial_count,
        count(*) filter (where primary_verdict = 'fail') as fail_count from lines group by task_id""",
    "stats_with_verdicts": """
      select s.* exclude (best), s.best.n as best_pr_number, coalesce(pass_count, 0) as pass_count,
        coalesce(partial_count, 0) as partial_count, coalesce(fail_count, 0) as fail_count
      from repo_stats s left join primary_counts p on p.task_id = s.best_task_id""",
    "contributors": """
      select user_id, pr_author, count(*) as total_submissions,
        count(*) filter (where status = 'completed') as completed_submissions,
        count(distinct repository_full_name) as repo_count,
        arg_max(id, (created_at, id)) as last_task_id, arg_max(status, (created_at, id)) as last_status,
        max(created_at) as last_submitted_at
      from tasks where pr_author <> '' group by user_id, pr_author""",
    "repo_contributors": """
      select user_id, repository_full_name, pr_author, arg_max(id, (created_at, id)) as last_task_id,
        arg_max(status, (created_at, id)) as last_status, max(created_at) as last_submitted_at, count(*) as submissions
      from tasks where pr_author is not null group by user_id, repository_full_name, pr_author""",
    "owners": """
      select repository_full_name, arg_min(r.user_id, (created_at, id)) as user_id, arg_min(login, (created_at, id)) as login
      from rules r join users u on u.user_id = r.user_id group by repository_full_name""",
    "saved": """
      select task_id, rule_idx, case when l_tax > 0.07 then concat(rule, ' (old)') else rule end as rule,
        primary_verdict as verdict, explanation from lines where l_linestatus = 'F'""",
    "activity": """
      select event_id as id, concat('repo', user_id % 20) as repository_full_name,
        case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status, ts as created_at
      from events""",
    "task_events": """
      select event_id, event_id % 200 as task_id, user_id,
        case event_type when 'view' then 'task_progress' when 'click' then 'task_progress'
          when 'purchase' then 'task_completed' when 'error' then 'task_failed' else 'task_requeued' end as type,
        case event_type when 'view' then 'running' when 'click' then 'running'
          when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end as status,
        case when event_type in ('view', 'click') then cast(floor(value) as bigint) end as progress,
        case when event_type = 'click' then null else concat(event_type, ' ', event_id) end as message, ts
      from events""",
    "pr_events": f"""
      select o_orderkey as event_id, case substr(o_orderpriority, 1, 1) when '1' then 'opened' when '2' then 'synchronize'
          when '3' then 'reopened' when '4' then 'closed' else 'labeled' end as action,
        o_custkey % 9 as installation_id, {_name('o_custkey // 75')} as repository_full_name, o_orderkey % 50 as pr_number,
        concat('sha', o_orderkey) as head_sha, concat('branch-', o_orderkey % 50) as head_ref,
        concat('dev', o_custkey % 37) as author, o_orderdate as ts from orders""",
    "stale": """
      select distinct collection_name, source from chunks
      where source in (select concat('f', doc_id) from labels where toxic = 1)""",
    "report_lines": """
      select *, row_number() over (partition by task_id order by section, rule_idx) as line_no,
        case when section = 2 or sentence = '' then 'Sin observaciones.' else sentence end as remark
      from (select *, (case final_verdict when 'pass' then 2 when 'partial' then 1 else 0 end)::bigint as section,
              regexp_replace(string_split(explanation, '. ')[1], '^\\s+|\\s+$', '', 'g') as sentence from final)""",
    "paths": """
      select doc_id, concat(case doc_id % 7 when 0 then 'node_modules/' when 1 then 'a/node_modules/b/' when 2 then 'data/'
          when 3 then 'src/data/' when 4 then 'build/' when 5 then '' else 'src/.hidden/' end,
          case doc_id % 11 when 0 then 'Dockerfile' when 1 then 'x.PY' when 2 then 'package-lock.json'
          when 3 then 'logo.png' when 4 then '.env.example' when 5 then 'Makefile' when 6 then '.py'
          when 7 then concat(doc_id, '.cs') else concat(lang, '.py') end) as path
      from documents""",
    "code_tree_files": "select repo, string_split(file_path, '/') as p from code",
    "doc_tree_files": """
      select repo, string_split(file_path, '/') as p from current_files where regexp_matches(file_path, '\\.(py|js|go)$')""",
    "doc_pieces": f"""
      select md5(concat(repo, '|{MODEL}|{STRATEGY}')) as collection_name, repo, file_path as source, chunk as content,
        md5(concat(file_path, '|', chunk)) as chunk_hash, min(start_line) as start_line,
        min(start_line) + any_value(length(chunk) - length(replace(chunk, chr(10), ''))) as end_line
      from ({_windows('current_files', 1000, 100)}) group by repo, file_path, chunk""",
    "doc_features": """
      select repo, chunk_hash, slot, count(*) as n from (
        select repo, chunk_hash, cast(('0x' || substr(md5(lower(word)), 1, 8)) as bigint) % 64 as slot
        from (select repo, chunk_hash, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+')) as word from doc_pieces)) group by all""",
    "doc_vectors": """
      select repo, chunk_hash, slot, (n / sqrt(sum(n * n) over (partition by repo, chunk_hash)))::float::double as value from doc_features""",
    "doc_norms": "select repo, chunk_hash, sqrt(sum(value * value)) as norm from doc_vectors group by all",
    "doc_rules": """
      select id as query_id, repo_no as task_id, rule_idx, concat('src', repo_no) as repo, rule_text,
        concat('https://github.com/', repository_full_name, '.git') as url from asked""",
    "doc_pairs": """
      select r.query_id, p.repo, p.source, p.content, p.chunk_hash, p.start_line, p.end_line,
        round(coalesce(d.dot, 0) / (q.norm * n.norm), 9) as similarity
      from doc_rules r join doc_pieces p on p.repo = r.repo
      join (select id, sqrt(sum(value::double * value::double)) as norm from rule_vectors group by id) q on q.id = r.query_id
      join doc_norms n on n.repo = p.repo and n.chunk_hash = p.chunk_hash
      left join (select r.query_id, v.repo, v.chunk_hash, sum(v.value * w.value::double) as dot
                 from doc_rules r join rule_vectors w on w.id = r.query_id join doc_vectors v on v.repo = r.repo and v.slot = w.slot
                 group by all) d on d.query_id = r.query_id and d.repo = p.repo and d.chunk_hash = p.chunk_hash""",
    "doc_hits": """
      select *, row_number() over (partition by query_id order by similarity desc, chunk_hash) as hit_no from doc_pairs
      qualify hit_no <= 5""",
    "doc_groups": """
      select h.query_id, h.source, round(max(similarity), 4) as relevance_score, min(hit_no) as first_hit, any_value(f.content) as file_text,
        any_value(string_split(f.content, chr(10))) as lines
      from doc_hits h join current_files f on f.repo = h.repo and f.file_path = h.source group by h.query_id, h.source""",
    "doc_islands": """
      select query_id, source, min(a) as start, max(b) as stop from (
        select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by query_id, source order by a, b rows unbounded preceding) as island
        from (select *, max(b) over (partition by query_id, source order by a, b rows between unbounded preceding and 1 preceding) as before
              from (select h.query_id, h.source, greatest(0, start_line - 21) as a, least(len(lines), end_line + 20) as b
                    from doc_hits h join doc_groups g on g.query_id = h.query_id and g.source = h.source) where a < b))
      group by query_id, source, island""",
    "doc_sections": """
      select i.query_id, i.source, string_agg(array_to_string(g.lines[i.start + 1:i.stop], chr(10)),
          concat(chr(10), chr(10), '... (content omitted) ...', chr(10), chr(10)) order by i.start) as text
      from doc_islands i join doc_groups g on g.query_id = i.query_id and g.source = i.source group by all""",
    "doc_contexts": """
      select g.query_id, g.source, row_number() over (partition by g.query_id order by relevance_score desc, first_hit) as file_no,
        concat('[Archivo: ', string_split(g.source, '/')[-1], ']', chr(10), case when length(file_text) <= 10000 then file_text
          when length(s.text) > 10000 then concat(left(s.text, 10000), chr(10), '... (truncated)') else s.text end) as file_content
      from doc_groups g left join doc_sections s on s.query_id = g.query_id and s.source = g.source""",
    "doc_prompts": """
      select r.*, concat('Repository: ', r.url, chr(10), chr(10), '## Repository Map', chr(10), m.map_text, chr(10), chr(10), '## Relevant code files', chr(10),
        coalesce(c.files, '(No relevant files found)'), chr(10), chr(10), '## Rule to evaluate', chr(10), r.rule_text) as prompt
      from doc_rules r join doc_maps m on m.repo = r.repo
      left join (select query_id, string_agg(file_content, concat(chr(10), chr(10)) order by file_no) as files from doc_contexts group by query_id) c
        on c.query_id = r.query_id""",
    "doc_answers": """
      select *, cast(('0x' || substr(md5(prompt), 1, 8)) as bigint) as digest,
        ['pass', 'partial', 'fail'][cast(('0x' || substr(md5(prompt), 1, 8)) as bigint) % 3 + 1] as verdict from doc_prompts""",
    "raw_responses": """
      select doc_id, case doc_id % 7 when 0 then concat('```json', chr(10), body, chr(10), '```') when 1 then body
          when 2 then concat('{"verdict": ', text) when 3 then to_json({note: text})::varchar
          when 4 then '{"verdict": null, "explanation": "x"}' when 5 then '["pass"]'
          else concat('  ', body, chr(10)) end as raw, text
      from (select doc_id, text, to_json({verdict: case doc_id % 5 when 0 then 'Pass' when 1 then 'PARTIAL' else 'maybe' end,
              explanation: text, suggestions: ['fix it', 'test it']})::varchar as body from documents)""",
}


def _map_lines(tree: str, symbols: str) -> str:
    """Lines of the repository maps of ``tree(repo, p)`` and ``symbols(repo, file_path, line, text)``."""
    return f"""
      select repo, block, p, line, text from (
        select repo, 0 as block, ['']::varchar[] as p, unnest([0, 1, 2, 3]) as line,
          unnest([concat('# Repository Map: ', repo), '', '## Directory Structure', '```text']) as text from (select distinct repo from {tree})
        union all
        select repo, 2, [''], unnest([0, 1, 2, 3]), unnest(['```', '', '## Code Symbols', '']) from (select distinct repo from {tree})
        union all
        select n.repo, 1, n.p, 0, concat(string_agg(case when d.i = len(n.p) then case when a.is_last then '└── ' else '├── ' end
            else case when a.is_last then '    ' else '│   ' end end, '' order by d.i), n.p[-1], case when any_value(n.is_dir) then '/' else '' end)
        from (select distinct repo, p[1:i] as p, i < len(p) as is_dir from (select repo, p, unnest(range(1, len(p) + 1)) as i from {tree})) n
        cross join (select unnest(range(1, 4)) as i) d
        join (select repo, p, p[-1] = max(p[-1]) over (partition by repo, p[1:len(p) - 1]) as is_last
              from (select distinct repo, p[1:i] as p from (select repo, p, unnest(range(1, len(p) + 1)) as i from {tree}))) a
          on a.repo = n.repo and a.p = n.p[1:d.i] and d.i <= len(n.p)
        group by n.repo, n.p
        union all select repo, 3, [file_path], line, text from ({symbols}))"""


def _map_parts(lines: str, part: int = 1000) -> str:
    return f"""
      select repo, n // {part} as part, string_agg(text, chr(10) order by n) as map_text
      from (select repo, text, row_number() over (partition by repo order by block, p, line) - 1 as n from ({lines})) group by repo, n // {part}"""


_CODE_SYMBOLS = """
  select repo, file_path, first as line, concat(repeat('  ', depth), '- ', kind, ' **', decl, '**', signature) as text from decl
  union all select distinct repo, file_path, 0, concat('### ', file_path) from decl
  union all select repo, file_path, max(first) + 1, '' from decl group by repo, file_path"""
_NO_SYMBOLS = "select '' as repo, '' as file_path, 0 as line, '' as text where false"
VIEWS["doc_maps"] = _map_parts(_map_lines("doc_tree_files", _NO_SYMBOLS), 10**9)


def _with(body: str) -> str:
    """Prefix the views that ``body`` needs, in order."""
    needed: list[str] = []

    def visit(sql: str, seen: tuple[str, ...]) -> None:
        for name, view in VIEWS.items():
            if name not in needed and name not in seen and re.search(rf"\b{name}\b", sql):
                visit(view, (*seen, name))
                if name not in needed:
                    needed.append(name)

    visit(body, ())
    order = [n for n in needed]
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
    return f"with {ctes}\n{body}" if ctes else body


def _page(keys: str, order: str, first: int, last: int, view: str, columns: str) -> str:
    over = f"partition by {keys} order by {order}" if keys else f"order by {order}"
    return f"select {columns} from (select *, row_number() over ({over}) as row_no from {view}) where row_no between {first} and {last}"


def _activity(hours: int, unit: str) -> str:
    n = hours if unit == "hour" else hours // 24
    end = f"date_trunc('{unit}', timestamp '2024-01-31 00:00:00')"
    step = f"interval 1 {unit}"
    return f"""
      select r.repository_full_name, b.bucket, count(a.id) as total,
        count(a.id) filter (where a.status = 'completed') as completed, count(a.id) filter (where a.status = 'failed') as failed
      from (select distinct repository_full_name from activity) r
      cross join (select unnest(generate_series({end} - {n - 1} * {step}, {end}, {step}))::timestamp as bucket) b
      left join activity a on a.repository_full_name = r.repository_full_name and date_trunc('{unit}', a.created_at) = b.bucket
        and a.created_at >= timestamp '2024-01-31 00:00:00' - interval {hours} hour
      group by r.repository_full_name, b.bucket"""


def _layers(order: str, chunk_filter: str = "true", k: int = 20, where: str = "true") -> str:
    return f"""
      with top as (select *, row_number() over (partition by query_id, branch order by similarity desc, chunk_hash) as n
                   from pairs where {chunk_filter} qualify n <= {k}),
      merged as (select *, row_number() over (partition by query_id, source order by (branch <> '') desc, {order}) as m
                 from top qualify m = 1),
      ranked as (select *, row_number() over (partition by query_id order by similarity desc, chunk_hash) as r
                 from merged qualify r <= {k})
      select query_id, source, branch, chunk_hash, similarity from ranked where {where}"""


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PARSED = "regexp_replace(regexp_replace(trimmed, '^```(?:json)?\\s*', ''), '\\s*```$', '')"
_LAST_NL = "length({0}) - length(string_split({0}, chr(10))[-1]) - 1"
_HOUR10 = "time_bucket(interval 10 second, ts)"

def _adjudication(rule: str, first: str, first_text: str, second: str, second_text: str) -> str:
    """The adjudication prompt as SQL."""
    values = {"rule": rule, "primary_verdict": first, "primary_explanation": first_text, "secondary_verdict": second, "secondary_explanation": second_text}
    parts = re.split(r"\{(\w+)\}", ADJUDICATION)
    return f"concat({', '.join(values[p] if i % 2 else _literal(p) for i, p in enumerate(parts))})"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digest(salt: str, prompt: str) -> str:
    """What ``catalog.digest_evaluator`` makes of a prompt."""
    return f"cast(('0x' || substr(md5(concat({salt}, {prompt})), 1, 8)) as bigint)"


def _answer(digest: str) -> str:
    return f"['pass', 'partial', 'fail'][{digest} % 3 + 1]"


def _said(digest: str) -> str:
    return f"concat('Digest ', {digest}, '. Offline.')"


#: The search of the whole check over windows of another size.
_SEARCHED = ("doc_pieces", "doc_features", "doc_vectors", "doc_norms", "doc_pairs", "doc_hits")
VIEWS |= {
    f"{name}_wide": re.sub(rf"\b({'|'.join(_SEARCHED)})\b", r"\1_wide", VIEWS[name].replace(_windows("current_files", 1000, 100), _windows("current_files", 2000, 200)))
    for name in _SEARCHED
}

#: The answers of the configured check: the model in force, the second one, and the judge where both differ.
_CONFIGURED = f"""
  c as (select *, cast(substr(repo, 4) as int) % 3 as kind, case when cast(substr(repo, 4) as int) % 2 = 0 then 0.5::double else 0.8::double end as approval_threshold from doc_prompts),
  m as (select *, case when kind = 0 then 'large' else 'small' end as model from c),
  a as (select *, {_digest('model', 'prompt')} as first, {_digest("'second'", 'prompt')} as second from m),
  v as (select *, {_answer('first')} as primary_verdict, {_answer('second')} as secondary_verdict from a),
  j as (select *, {_adjudication('rule_text', 'primary_verdict', _said('first'), 'secondary_verdict', _said('second'))} as judged_prompt, kind = 1 and primary_verdict <> secondary_verdict as differ from v),
  k as (select *, {_digest("'judge'", 'judged_prompt')} as third from j),
  e as (select *, case when differ then {_answer('third')} else primary_verdict end as verdict, {_said('case when differ then third else first end')} as explanation,
          case when differ then 'judge' else model end as llm_provider, case when differ then judged_prompt else prompt end as asked from k),
  s as (select *, (length(asked) + length(concat('{{"verdict": "', verdict, '", "explanation": "', explanation, '", "suggestions": []}}'))) // 4 as tokens_used,
          sum(case verdict when 'pass' then 1.0::double when 'partial' then 0.5::double else 0.0::double end) over (partition by task_id) / count(*) over (partition by task_id) as score from e)"""


BODIES: dict[str, str] = {
    "s1_code_paths": """
      with p as (select doc_id, path, string_split(path, '/') as parts, string_split(path, '/')[-1] as name from paths),
      f as (select *, (regexp_matches(name, '^.+\\.(py|js|ts|tsx|jsx|vue|sh|bash|yml|yaml|json|toml|sql|h|cpp|ino|css|html|md|txt|java|go|rb|php|rs|kt)$') or name = 'Dockerfile') as code,
        name in ('package-lock.json', 'uv.lock') or regexp_matches(name, '\\.(pdf|png|jpg|svg|woff|tex)$') as bad_name from p)
      select doc_id, path,
        code and not (bad_name or regexp_matches(path, '(^|/)(node_modules|\\.git|__pycache__|data)/')) as read,
        code and not ((bad_name and len(parts) > 1) or regexp_matches(path, '/(node_modules|\\.git|__pycache__|data)/')) as read_below_root
      from f""",
    "s2_map_paths": """
      select doc_id, path, not regexp_matches(replace(path, '.env.example', 'env'), '(^|/)\\.')
        and not regexp_matches(path, '(^|/)(node_modules|__pycache__|venv|dist|build)(/|$)')
        and (regexp_matches(path, '[^/]\\.(py|js|ts|tsx|jsx|java|go|rs|cs|yml|yaml|json|toml|sql|sh|bash|css|html|h|cpp|ino)$')
             or regexp_matches(path, '(^|/)(Dockerfile|Makefile|README\\.md)$')) as listed from paths""",
    "s3_rule_scan": "select id, user_id, repository_full_name, rule_text, position, enabled from rules",
    "s4_vector_table": "select collection_name, branch, chunk_hash, source, start_line, content from chunks where branch = ''",
    "s5_rule_import": f"""
      with l as (select doc_id, doc_id % 12 as existing, greatest(10 - doc_id % 12, 0) as slots, string_split(text, chr(10)) as lines from documents),
      e as (select doc_id, unnest(list_slice(lines, 1, slots)) as line, unnest(range(1, least(slots, len(lines)) + 1)) as n from l where slots > 0),
      c as (select doc_id, n, left({_STRIP.format('line')}, 500) as t from e)
      select l.doc_id as request_id, case when slots = 0 then 'full' else 'ok' end as state,
        coalesce(a.added, 0) as added, case when slots = 0 then 0 else greatest(len(lines) - slots, 0) end as skipped, coalesce(a.texts, '') as texts
      from l left join (select doc_id, count(*) as added, string_agg(t, '|' order by n) as texts from c where t <> '' group by doc_id) a
        on a.doc_id = l.doc_id""",
    "s6_rule_export": """
      select user_id, repository_full_name, part, to_json({rules: list(rule_text order by n)})::varchar as body
      from (select *, n // 40 as part from (select *, row_number() over (partition by user_id, repository_full_name order by position, id) - 1 as n from rules))
      group by user_id, repository_full_name, part""",
    "s7_webhook_payloads": """
      select action, installation_id, repository_full_name, pr_number, head_sha, head_ref, author,
        concat('https://github.com/', repository_full_name, '.git') as clone_url, ts from pr_events""",
    "s8_results": """
      select task_id, rule, primary_verdict as verdict, tokens_used, case when l_linestatus = 'F' then 1 else 2 end::bigint as related_files,
        concat('f', task_id) as first_file, secondary_verdict, primary_verdict = secondary_verdict as agreement from lines""",
    "s9_outcomes": """
      select id, case when status in ('completed', 'failed') then status when id % 5 = 0 then 'failed' else 'completed' end as status,
        case when status in ('pending', 'running') and id % 5 <> 0 then 100 else progress end as progress,
        case when status in ('pending', 'running') and id % 5 <> 0 then 'Done' else progress_message end as progress_message,
        case when status in ('pending', 'running') and id % 5 = 0 then 'boom' else error end as error,
        case when status in ('pending', 'running') then '{}' when has_result then concat('result ', id) end as result,
        case when status in ('pending', 'running') then created_at + interval 60 second else completed_at end as completed_at
      from tasks""",
    "s10_report_rows": """
      select task_id, case when approved then 'success' else 'failure' end as state,
        concat(case when approved then 'Aprobado' else 'Cambios requeridos' end, ' — ', pct, '% (umbral ', cast(floor(approval_threshold * 100) as bigint), '%)') as description
      from approved""",
    "f1_task_filter": """
      select u.user_id * 2 + a.k as request_id, t.id, t.user_id, t.pr_author, t.status
      from users u cross join (values (0, ''), (1, 'dev7')) a(k, author)
      join tasks t on t.user_id = u.user_id and t.status = 'failed' and (a.author = '' or t.pr_author = a.author)""",
    "f2_enabled_rules": "select id, rule_text, enabled from rules where coalesce(enabled, true)",
    "f3_metadata_filter": "select vec_id, language, node_type from chunks where language = 'python' and node_type = 'function_definition'",
    "f4_threshold": """
      select query_id, chunk_hash, similarity from hits where hit_no <= 5 and similarity >= 0.15""",
    "f5_ready_tasks": """
      select id, status, retry_after from tasks
      where status = 'pending' and (retry_after is null or retry_after <= timestamp '2000-01-01')""",
    "f6_author_contains": "select user_id, pr_author, total_submissions from contributors where contains(lower(pr_author), 'dev1')",
    "f7_language": """
      select repo, file_path, case regexp_extract(file_path, '\\.([^./]+)$', 1) when 'py' then 'python' when 'js' then 'javascript'
        when 'go' then 'go' when 'java' then 'java' end as language
      from (select repo, file_path from current_files union all select repo, file_path from code)""",
    "f8_task_summary": "select id, repository_full_name, status, progress, progress_message, created_at, completed_at, pr_number::double as pr_number, pr_author from tasks",
    "f8_task_detail": """
      select t.id, repository_url, t.repository_full_name, status, progress, progress_message, error, created_at, started_at,
        completed_at, pr_number::double as pr_number, pr_head_ref, pr_head_sha, pr_author, enable_cross_check, retry_count,
        l.rules, case when has_result then concat('result ', t.id) end as result
      from tasks t left join (select user_id, repository_full_name, string_agg(rule_text, '|' order by position, id) as rules from rules
        where coalesce(enabled, true) group by all) l on l.user_id = t.user_id and l.repository_full_name = t.repository_full_name""",
    "f9_verdicts": """
      select raw, case when lower(raw) in ('pass', 'fail', 'partial') then lower(raw) else 'fail' end as verdict, count(*) as n
      from (select case l_linenumber when 1 then 'PASS' when 2 then 'Fail' when 3 then 'partial' when 4 then ''
              when 5 then null else l_returnflag end as raw from lineitem) group by raw""",
    "f10_terminal": "select status, status in ('completed', 'failed') as terminal, count(*) as n from tasks group by status",
    "f11_config_violations": """
      select version, concat_ws(',', case when max_evaluations_per_pr not between 1 and 20 then 'max_evaluations_per_pr' end,
        case when approval_threshold > 1.0 then 'approval_threshold' end,
        case when max_chunks_per_rule not between 1 and 20 then 'max_chunks_per_rule' end,
        case when llm_model = 'unknown-model' then 'llm_model' end, case when llm_primary_model = 'no-such' then 'llm_primary_model' end,
        case when llm_secondary_model = '' then 'llm_secondary_model' end) as violations from config_requests""",
    "f11_rule_violations": "select doc_id, case when length(text) between 1 and 500 then '' else 'rule_text' end as violations from documents",
    "j1_indexed_repositories": "select repository_id, full_name, collection_name from indexed",
    "j2_stored_hashes": """
      select url, file_path, sha256(content) as content_hash from stored_files s join indexed i on i.repository_id = cast(substr(s.repo, 4) as bigint)""",
    "j3_repo_contributors": "select * from repo_contributors",
    "j4_all_contributors": "select * from contributors",
    "j5_contributor_results": "select * replace (best_task_id::double as best_task_id, best_pr_number::double as best_pr_number) from stats_with_verdicts",
    "j6_repo_owner": "select * from owners",
    "j7_visible_tasks": """
      select * from (select distinct l_orderkey as task_id, l_partkey % 7 as user_id from lineitem) r
      where exists (select 1 from tasks t where t.id = r.task_id and t.user_id = r.user_id)
         or exists (select 1 from task_viewers v where v.task_id = r.task_id and v.user_id = r.user_id)""",
    "j8_config_in_force": """
      select r.id // 4 as user_id, r.full_name as repository_full_name, coalesce(max_evaluations_per_pr, 3) as max_evaluations_per_pr,
        coalesce(approval_threshold, 0.8::double) as approval_threshold, coalesce(enable_cross_check, true) as enable_cross_check,
        coalesce(pr_evaluation_enabled, true) as pr_evaluation_enabled, coalesce(max_chunks_per_rule, 5) as max_chunks_per_rule,
        coalesce(llm_model, 'gemini-2.5-flash') as llm_model, coalesce(llm_primary_model, 'azure/gpt-4.1') as llm_primary_model,
        coalesce(llm_secondary_model, 'azure/gpt-4o') as llm_secondary_model
      from repositories r left join repo_configs c on c.user_id = r.id // 4 and c.repository_full_name = r.full_name""",
    "j9_snapshot_diff": "select * from changes",
    "j10_delete_sources": """
      select collection_name, branch, source, chunk_hash from chunks c
      where branch <> '' or not exists (select 1 from stale s where s.collection_name = c.collection_name and s.source = c.source)""",
    "j10_delete_branch": """
      select collection_name, branch, count(*) as n from chunks
      where not (branch = 'pr-1' and collection_name in (select collection_name from chunks where language = 'python'))
      group by collection_name, branch""",
    "j10_delete_hashes": """
      select cast(substr(repo, 4) as bigint) * 2 as indexed_repository_id, file_path, sha256(content) as content_hash
      from stored_files s
      where not exists (select 1 from changes c where c.change = 'deleted' and c.repo = s.repo and c.file_path = s.file_path
          and cast(substr(c.repo, 4) as bigint) in (select id from repositories))""",
    "j11_similarity_join": "select query_id, collection_name, chunk_hash, similarity from hits",
    "j11_similarity_blocks": """
      select query_id, collection_name, chunk_hash, similarity from pairs
      where branch = 'pr-1' qualify row_number() over (partition by query_id order by similarity desc, chunk_hash) <= 20""",
    "j12_resume": """
      select l.task_id, l.rule_idx, l.rule, s.verdict, s.explanation, s.rule is not null as restored
      from lines l left join saved s on s.task_id = l.task_id and s.rule_idx = l.rule_idx and s.rule = l.rule""",
    "j12_remaining": """
      select l.task_id, l.rule_idx, l.rule from lines l
      where not exists (select 1 from saved s where s.task_id = l.task_id and s.rule_idx = l.rule_idx and s.rule = l.rule)""",
    "j13_file_text": "select query_id, source, found, md5(file_text) as text_md5 from grouped",
    "j14_installation": """
      select t.id, t.user_id, t.repository_full_name, string_split(t.repository_full_name, '/')[1] as owner, i.installation_id::double as installation_id
      from tasks t left join (
        select (s_suppkey // 5) // 4 as user_id, concat('org', (s_suppkey // 5) // 4 + s_nationkey % 2) as account, min(s_suppkey) as installation_id
        from supplier group by all) i on i.user_id = t.user_id and i.account = string_split(t.repository_full_name, '/')[1]""",
    "j15_patch_rules": """
      select id, user_id,
        case when p_size % 5 = 0 or p_size % 3 = 0 then rule_text else concat(rule_text, ' (new)') end as rule_text,
        case when p_size % 5 = 0 or p_size % 4 = 1 then enabled else p_size % 2 = 0 end as enabled from rules""",
    "j15_delete_rules": """
      select r.id, r.user_id from rules r join part p on p.p_partkey = r.id
      where not (p.p_type = 'ECONOMY' and r.user_id = (r.id // 100) // 4)""",
    "a1_tasks_per_filter": "select user_id, repository_full_name, pr_author, status, count(*) as n from tasks group by all",
    "a1_rules_per_repo": "select user_id, repository_full_name, count(*) as n from rules group by all",
    "a1_tasks_per_pr": "select repository_full_name, pr_number, count(*) as n from tasks where pr_number is not null group by all",
    "a1_chunks_per_collection": "select collection_name, count(*) as n from chunks group by all",
    "a2_submissions": "select user_id, repository_full_name, pr_author, count(*) as submissions from tasks where pr_author is not null group by all",
    "a3_author_counts": "select user_id, pr_author, total_submissions, completed_submissions, repo_count from contributors",
    "a4_repo_stats": "select * exclude (best) replace (best_task_id::double as best_task_id), best.n::double as best_pr_number from repo_stats",
    "a5_verdict_counts": """
      select task_id, count(*) filter (where final_verdict = 'pass') as pass_count, count(*) filter (where final_verdict = 'partial') as partial_count,
        count(*) filter (where final_verdict not in ('pass', 'partial')) as fail_count from final group by task_id""",
    "a5_nested_counts": "select * from primary_counts",
    "a6_shown_counts": """
      select task_id, count(*) filter (where adjudicated_verdict = 'pass') as pass_count, 0::bigint as partial_count, 0::bigint as fail_count,
        count(*) filter (where adjudicated_verdict is null) as unknown_count from lines group by task_id""",
    "a7_scores": "select task_id, rules, round(score, 6) as score, round(ui_score, 6) as ui_score from scored",
    "a8_approval": "select task_id, approval_threshold, approved, pct from approved",
    "a9_contributor_totals": """
      select user_id, pr_author, repository_full_name, sum(total_submissions)::bigint as total_submissions,
        sum(completed_submissions)::bigint as completed_submissions, grouping(repository_full_name)::bigint as level
      from repo_stats group by grouping sets ((user_id, pr_author, repository_full_name), (user_id, pr_author))""",
    "a10_verdict_share": """
      select user_id, pr_author, repository_full_name,
        round(100.0::double * pass_count / nullif(pass_count + partial_count + fail_count, 0), 6) as pass_pct,
        round(100.0::double * partial_count / nullif(pass_count + partial_count + fail_count, 0), 6) as partial_pct,
        round(100.0::double * fail_count / nullif(pass_count + partial_count + fail_count, 0), 6) as fail_pct
      from stats_with_verdicts""",
    "a11_next_positions": """
      select n.user_id, n.repository_full_name, conv_id, turn, coalesce(m.last, -1) + row_number() over (
          partition by n.user_id, n.repository_full_name order by conv_id, turn) as position
      from (select conv_id, turn, (conv_id // 10) // 4 as user_id,
              concat('org', (conv_id // 10) // 4, '/repo', conv_id // 10) as repository_full_name
            from conversations) n
      left join (select user_id, repository_full_name, max(position) as last from rules group by all) m
        on m.user_id = n.user_id and m.repository_full_name = n.repository_full_name""",
    "a12_collections": "select collection_name, count(*) as chunks, bool_or(branch = '') as main_indexed from chunks group by all",
    "a13_hits_by_file": """
      select g.query_id, g.source, relevance_score, language, coalesce(symbols, '') as symbols, hits
      from grouped g left join symbol_lists s on s.query_id = g.query_id and s.source = g.source""",
    "a14_activity_day": _activity(24, "hour"),
    "a14_activity_week": _activity(168, "day"),
    "a14_activity_month": _activity(720, "day"),
    "a15_dashboard": """
      select l.user_id, count(*) as shown, count(*) filter (where status = 'completed') as completed,
        count(*) filter (where status in ('pending', 'running')) as open_tasks,
        cast(floor(count(*) filter (where status = 'completed') / count(*)::double * 100 + 0.5) as bigint) as completed_pct,
        any_value(total) as total
      from (select *, row_number() over (partition by user_id order by created_at desc, id) as n,
              count(*) over (partition by user_id) as total from tasks) l where n <= 50 group by l.user_id""",
    "a16_contributor_figures": """
      select user_id, count(*) as contributors, count(*) filter (where completed_submissions > 0) as with_completed
      from contributors group by user_id""",
    "a17_directories": """
      with f as (select repo, file_path, length(content) as length, string_split(file_path, '/') as parts from current_files
                 where regexp_matches(file_path, '\\.(py|js|go)$')
                 union all select repo, file_path, length, string_split(file_path, '/') from code)
      select repo, dir, count(*) as files, sum(length)::bigint as bytes
      from (select repo, length, array_to_string(parts[1:i], '/') as dir from (select *, unnest(range(1, len(parts))) as i from f))
      group by repo, dir""",
    "a18_task_rules": """
      select t.id, l.part, l.n_rules, l.rules_md5 from tasks t join (
        select user_id, repository_full_name, coalesce((n - 1) // 1000, 0) as part, count(n) as n_rules,
          md5(coalesce(string_agg(rule_text, '|' order by position, id) filter (where n is not null), '')) as rules_md5
        from (select *, case when coalesce(enabled, true) then row_number() over (partition by user_id, repository_full_name, coalesce(enabled, true) order by position, id) end as n,
                bool_or(coalesce(enabled, true)) over (partition by user_id, repository_full_name) as used from rules)
        where n is not null or not used group by all) l on l.user_id = t.user_id and l.repository_full_name = t.repository_full_name
      where t.status = 'pending'""",
    "w1_rules_with_total": """
      select id, row_no, total from (
        select id, row_number() over (partition by user_id, repository_full_name order by position, id) as row_no,
          count(*) over (partition by user_id, repository_full_name) as total from rules) where row_no <= 5""",
    "w2_latest_per_author": _page("user_id, pr_author", "created_at desc, id desc", 1, 1, "(select * from tasks where pr_author is not null)", "user_id, pr_author, id, status, created_at"),
    "w2_latest_per_repo_author": _page("repository_full_name, pr_author", "created_at desc, id desc", 1, 1, "(select * from tasks where pr_author is not null)", "repository_full_name, pr_author, id, status, created_at"),
    "w2_latest_completed": _page("repository_full_name", "created_at desc, id desc", 1, 1, "(select * from tasks where has_result)", "repository_full_name, id, pr_number::double as pr_number"),
    "w3_nearest_chunks": "select query_id, hit_no, chunk_hash, similarity from hits where hit_no <= 5",
    "w5_upsert_configs": _page("user_id, repository_full_name", "version desc", 1, 1, "config_requests", "user_id, repository_full_name, version, approval_threshold, llm_model"),
    "w5_upsert_hashes": """
      select repo, file_path, sha256(content) as content_hash from current_files
      union all select repo, file_path, sha256(content) from stored_files s
      where not exists (select 1 from current_files c where c.repo = s.repo and c.file_path = s.file_path)""",
    "w5_upsert_known": f"""
      select coalesce(o.url, n.url) as url, coalesce(n.full_name, o.full_name) as full_name
      from (select url, case when id % 3 = 0 then null else full_name end as full_name from repositories) o
      full outer join (select distinct concat('https://github.com/', repository_full_name, '.git') as url,
          case when repo_no % 2 = 0 then null else concat(repository_full_name, '!') end as full_name from rules) n on n.url = o.url""",
    "w6_context_budget": f"""
      with r as (select *, row_number() over (partition by query_id order by relevance_score desc, first_hit) as file_no from grouped),
      p as (select *, coalesce(sum(length(file_text)) over (partition by query_id order by file_no rows between unbounded preceding and 1 preceding), 0)::bigint as used from r),
      f as (select *, case when used + length(file_text) <= 6000 then 'full' when used < 6000 then 'partial' else 'skipped' end as fit,
        left(file_text, greatest(6000 - used, 0)) as head, 6000 - used as room from p)
      select query_id, file_no, source, used, fit, md5(case fit when 'full' then file_text when 'skipped' then string_split(file_text, chr(10))[1]
        else concat(case when {_LAST_NL.format('head')} > room * 0.3 then left(head, {_LAST_NL.format('head')}) else head end,
          chr(10), '... (file truncated due to token limit)') end) as shown_md5 from f""",
    "w7_line_ranges": """
      with t as (select query_id, source, len(string_split(file_text, chr(10))) as total from grouped),
      r as (select h.query_id, h.source, greatest(0, start_line - 21) as a, least(total, end_line + 20) as b
            from good_hits h join t on t.query_id = h.query_id and t.source = h.source),
      m as (select *, max(b) over (partition by query_id, source order by a, b rows between unbounded preceding and 1 preceding) as before
            from r where a < b),
      i as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by query_id, source order by a, b rows unbounded preceding) as island from m)
      select query_id, source, min(a) as start, max(b) as stop from i group by query_id, source, island""",
    "w8_rolling_calls": """
      select user_id as caller, ts, count(*) as calls, any_value(last_minute) as last_minute, any_value(last_minute) > 1 as over_limit
      from (select user_id, ts, count(*) over (partition by user_id order by ts range between interval 59999999 microsecond preceding and current row) as last_minute from events)
      group by user_id, ts""",
    "w9_evaluation_numbers": """
      select id, t.repository_full_name, pr_number, eval_no from (
        select *, row_number() over (partition by repository_full_name, pr_number order by created_at, id) as eval_no from tasks where pr_number is not null) t
      left join repo_configs c on c.user_id = t.user_id and c.repository_full_name = t.repository_full_name
      where eval_no <= coalesce(c.max_evaluations_per_pr, 3)""",
    "w10_report_lines": "select task_id, rule_idx, line_no, section, remark from report_lines",
    "t1_task_page": _page("user_id", "completed_at desc nulls first, id", 21, 40, "tasks", "user_id, row_no, id, completed_at"),
    "t1_global_page": _page("", "created_at, id", 51, 75, "tasks", "id, created_at"),
    "t2_rule_page": _page("user_id, repository_full_name", "rule_text desc, id", 1, 10, "rules", "id, rule_text, row_no"),
    "t3_page_count": "select user_id, status, count(*) as total, greatest(1, (count(*) + 19) // 20) as pages from tasks group by user_id, status",
    "t4_latest_tasks": _page("user_id", "created_at desc, id", 1, 50, "tasks", "user_id, id, created_at, row_no"),
    "t5_ready_first": _page("", "created_at, id", 1, 100, "(select * from tasks where status = 'pending' and (retry_after is null or retry_after <= timestamp '2000-01-01'))", "id, created_at"),
    "t6_by_last_submission": "select * from repo_contributors order by last_submitted_at desc, last_task_id desc",
    "t7_rule_slots": "select id, repository_full_name, slot from slots",
    "u1_grants": "select id as task_id, user_id from tasks union all select task_id, user_id from task_viewers",
    "u2_path_sets": """
      select repo, count(*) filter (where change = 'new') as new, count(*) filter (where change = 'deleted') as deleted,
        count(*) filter (where change = 'changed') as changed, count(*) filter (where change = 'unchanged') as unchanged
      from changes group by repo""",
    "u3_layer_union": "select collection_name, branch, count(*) as n, count(distinct source) as sources from chunks group by all",
    "u4_repository_names": """
      with b as (select full_name as name, 0 as list_no, id as pos from repositories
        union all select repository_full_name, 1, id from rules union all select repository_full_name, 1, id + 1000000 from activity)
      select name, list_no::bigint as list_no, min(pos) as pos from b where list_no = (select min(list_no) from b x where x.name = b.name) group by name, list_no""",
    "x1_content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "x2_keys": f"select file_path, md5(concat(file_path, '|', content)) as chunk_hash, md5(concat(repo, '|{MODEL}|{STRATEGY}')) as collection_name from stored_files",
    "x3_cosine": "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 9) as similarity from embeddings",
    "x4_line_span": """
      with c as (select doc_id, text, substr(text, n_chars // 2, 200) as chunk from documents where n_chars >= 2
                 union all select doc_id, text, substr(text, 1, 200) from documents where n_chars < 2),
      s as (select *, instr(text, chunk) as pos from c),
      n as (select *, case when pos > 0 then 1 + length(left(text, pos - 1)) - length(replace(left(text, pos - 1), chr(10), '')) else 0 end as start_line from s)
      select doc_id, start_line, start_line + length(chunk) - length(replace(chunk, chr(10), '')) as end_line,
        case when doc_id % 2 = 0 and start_line <> 0 then start_line else -1 end as stored_line from n""",
    "x5_tokens": "select doc_id, length(text) // 4 as tokens from documents",
    "x6_truncate": f"""
      with h as (select doc_id, text, n_chars // 7 * 4 as room, left(text, n_chars // 7 * 4) as head from documents)
      select doc_id, case when length(text) <= room then text else concat(
        case when {_LAST_NL.format('head')} > room * 0.5 then left(head, {_LAST_NL.format('head')}) else head end,
        chr(10), '... (content truncated due to token limit)') end as cut from h""",
    "x7_prompts": "select query_id, length(prompt) as chars, md5(prompt) as prompt_md5 from doc_prompts",
    "x8_parse_response": f"""
      with t as (select doc_id, raw, {_STRIP.format('raw')} as trimmed from raw_responses),
      c as (select doc_id, raw, case when starts_with(trimmed, '```') then {_PARSED} else trimmed end as j from t),
      k as (select doc_id, raw, j, json_valid(j) as ok,
              case when json_valid(j) then json_type(j) end as kind,
              case when json_valid(j) then json_extract_string(j, '$.verdict') end as verdict,
              case when json_valid(j) then json_type(j, '$.verdict') end as verdict_kind,
              case when json_valid(j) then json_extract_string(j, '$.explanation') end as explanation,
              case when json_valid(j) then json_array_length(j, '$.suggestions') end as n from c)
      select doc_id, case when not ok or kind <> 'OBJECT' or verdict_kind = 'NULL' then 'fail'
          when lower(verdict) in ('pass', 'fail', 'partial') then lower(verdict) else 'fail' end as verdict,
        case when not ok then concat('{PARSE_ERROR}', left(raw, 500)) when kind <> 'OBJECT' or verdict_kind = 'NULL' then 'Error evaluating with LLM'
          else coalesce(explanation, '') end as explanation,
        case when not ok or kind <> 'OBJECT' or verdict_kind = 'NULL' then 0 else coalesce(n, 0) end::bigint as suggestions,
        case when not ok then 'PARSE_ERROR' when kind <> 'OBJECT' or verdict_kind = 'NULL' then 'EVALUATION_ERROR' end as error_code from k""",
    "x9_parse_error": """
      select id, case when error is null then null when id % 4 = 0 then 'LLM_UNAVAILABLE' when id % 4 = 2 then 'OTHER' end as code,
        case when error is null then null when id % 4 = 0 then concat('no answer for ', id) when id % 4 = 2 then concat('m', id) else error end as message,
        case when error is not null and id % 4 = 0 then 'timeout' end as technical,
        case when error is null then null when id % 4 = 0 then 'Servicio de IA no disponible' else 'Error en la evaluación' end as title
      from tasks""",
    "x10_file_header": """
      select file_path, concat('[Archivo: ', string_split(file_path, '/')[-1], ' | Funciones: ', string_agg(decl, ', ' order by first), ']') as header
      from decl group by file_path""",
    "x11_first_sentence": f"select doc_id, {_STRIP.format(chr(40) + 'string_split(text, ' + chr(39) + '. ' + chr(39) + ')[1]' + chr(41))} as sentence from documents",
    "x12_report_bodies": """
      with n as (select repository_full_name, pr_number, count(*) as eval_no from tasks group by all),
      s as (select task_id, section, line_no, rule, remark, min(line_no) over (partition by task_id, section) = line_no as opens,
              max(line_no) over (partition by task_id, section) = line_no as closes from report_lines),
      b as (select task_id, string_agg(concat(
          case when opens then concat(chr(10), '#### ', case section when 0 then 'No cumplido' when 1 then 'Pendiente de revisión' else 'Superado' end, chr(10), chr(10)) else '' end,
          case when section = 0 then '<details open>' else '<details>' end, chr(10), '<summary>', line_no, '. ', rule, '</summary>', chr(10), chr(10), remark,
          chr(10), chr(10), '</details>', chr(10), case when closes then concat(chr(10), '---') else '' end), chr(10) order by line_no) as text from s group by task_id)
      select a.task_id, 0::bigint as part, concat_ws(chr(10),
        concat('## Informe de evaluación #', n.eval_no, chr(10), chr(10), '**Resultado: ', case when approved then 'APROBADO' else 'NO APROBADO' end,
          '** — ', pct, '% de normas superadas (mínimo: ', cast(floor(approval_threshold * 100) as bigint), '%)', chr(10), chr(10), '---'),
        b.text, '_Generado automáticamente_') as body
      from approved a join tasks t on t.id = a.task_id join n on n.repository_full_name = t.repository_full_name and n.pr_number = t.pr_number
      left join b on b.task_id = a.task_id""",
    "x13_clips": """
      select doc_id, left(text, 140) as status_line, case when length(text) > 120 then concat(left(text, 120), '…') else text end as preview,
        left(text, 500) as rule_text from documents""",
    "x14_durations": """
      select id, case when completed_at is null then '—' when id % 300 = 0 then '0ms' when id % 300 < 60 then concat(id % 300, '.0s')
        else concat((id % 300) // 60, 'm ', (id % 300) % 60, 's') end as took from tasks""",
    "x15_percent_text": "select task_id, case when ui_score is null then '—' else concat(cast(floor(ui_score * 100 + 0.5) as bigint), '%') end as shown from scored",
    "x16_owner_repo": """
      select full_name, string_split(full_name, '/')[1] as owner, string_split(full_name, '/')[2] as repo, url as clone_url,
        concat('example.org/', full_name) as safe_url from repositories""",
    "x17_floors": "select event_id, date_trunc('hour', ts)::timestamp as hour, strftime(ts, '%Y-%m-%d') as day from events",
    "x18_backoff": "select id, completed_at + interval 120 second as retry_after, retry_count + 1 as retry_count from tasks where status = 'failed'",
    "x19_labels": """
      select 'task' as kind, status as value, case status when 'pending' then 'Pendiente' when 'running' then 'Ejecutando' when 'completed' then 'Completado' else 'Fallido' end as label, count(*) as n
      from tasks group by status
      union all select 'verdict', case when l_linestatus = 'F' then adjudicated_verdict else 'odd' end,
        case when l_linestatus <> 'F' then 'odd' when adjudicated_verdict is null then '—' else 'Correcto' end, count(*)
      from lines group by adjudicated_verdict, l_linestatus""",
    "d1_chunks": f"""
      select repo, file_path, chunk_no, md5(chunk) as content_md5, start_line,
        start_line + length(chunk) - length(replace(chunk, chr(10), '')) as end_line from ({_windows('current_files', 1000, 100)})""",
    "d2_limited_chunks": f"""
      select file_path, md5(chunk) as content_md5, start_line, start_line + length(chunk) - length(replace(chunk, chr(10), '')) as end_line, 'file' as node_type
      from ({_windows("(select * from current_files where length(content) > 2048)", 2048, 256)})
      union all select file_path, md5(content), 1, 1 + length(content) - length(replace(content, chr(10), '')), 'file'
      from current_files where length(content) <= 2048""",
    "d3_declarations": "select file_path, node_type, decl as node_name, first::bigint as start_line, last::bigint as end_line from decl",
    "d4_symbols": "select repo, file_path, first::bigint as line, kind, decl as name, depth::bigint as depth, signature from decl",
    "d5_repository_maps": _map_parts(_map_lines("code_tree_files", _CODE_SYMBOLS)),
    "d10_evaluate": """
      select query_id, task_id, rule_idx, verdict, concat('Digest ', digest, '. Offline.') as explanation,
        (length(prompt) + length(concat('{"verdict": "', verdict, '", "explanation": "Digest ', digest, '. Offline.", "suggestions": []}'))) // 4 as tokens_used
      from doc_answers""",
    "d10_whole_check": """
      with s as (select task_id, case verdict when 'pass' then 2 when 'partial' then 1 else 0 end as section, rule_idx, rule_text, verdict,
              case verdict when 'pass' then 'Sin observaciones.' else concat('Digest ', digest) end as remark from doc_answers),
      n as (select *, row_number() over (partition by task_id order by section, rule_idx) as line_no,
              row_number() over (partition by task_id, section order by rule_idx) = 1 as opens,
              row_number() over (partition by task_id, section order by rule_idx desc) = 1 as closes from s),
      b as (select task_id, string_agg(concat(
          case when opens then concat(chr(10), '#### ', case section when 0 then 'No cumplido' when 1 then 'Pendiente de revisión' else 'Superado' end, chr(10), chr(10)) else '' end,
          case when section = 0 then '<details open>' else '<details>' end, chr(10), '<summary>', line_no, '. ', rule_text, '</summary>', chr(10), chr(10), remark,
          chr(10), chr(10), '</details>', chr(10), case when closes then concat(chr(10), '---') else '' end), chr(10) order by line_no) as text,
          sum(case verdict when 'pass' then 1.0::double when 'partial' then 0.5::double else 0.0::double end) / count(*) as score from n group by task_id),
      t as (select *, score >= 0.8 as approved, cast(floor(score * 100) as bigint) as pct from b)
      select task_id, case when approved then 'success' else 'failure' end as state,
        concat(case when approved then 'Aprobado' else 'Cambios requeridos' end, ' — ', pct, '% (umbral 80%)') as description, 0::bigint as part,
        concat_ws(chr(10), concat('## Informe de evaluación #1', chr(10), chr(10), '**Resultado: ', case when approved then 'APROBADO' else 'NO APROBADO' end,
          '** — ', pct, '% de normas superadas (mínimo: 80%)', chr(10), chr(10), '---'), text, '_Generado automáticamente_') as body from t""",
    "d6_embeddings": """
      select r.id, d.slot::bigint as slot, round(coalesce(v.value, 0)::double, 5) as value
      from (select id, unnest(range(64)) as slot from rules) d join rules r on r.id = d.id
      left join rule_vectors v on v.id = d.id and v.slot = d.slot""",
    "d7_incremental_index": f"""
      select md5(concat(repo, '|{MODEL}|{STRATEGY}')) as collection_name, '' as branch, repo as repo_name, file_path as source, md5(concat(file_path, '|', chunk)) as chunk_hash,
        min(start_line) as start_line, min(start_line) + any_value(length(chunk) - length(replace(chunk, chr(10), ''))) as end_line
      from ({_windows('current_files', 1000, 100)}) group by repo, file_path, chunk""",
    "d7_branch_delta": f"""
      select repo as repo_name, '' as branch, count(*) as chunks, count(distinct file_path) as sources
      from (select distinct repo, file_path, chunk from ({_windows('stored_files', 1000, 100)})) group by repo
      union all
      select repo, case when repo in (select repo from stored_files) then 'pr-1' else '' end, count(*), count(distinct file_path)
      from (select distinct w.repo, w.file_path, chunk from ({_windows('current_files', 1000, 100)}) w
            join changes c on c.repo = w.repo and c.file_path = w.file_path and c.change in ('new', 'changed')) group by repo""",
    "d7_vector_index": f"""
      select p.collection_name, '' as branch, p.source, p.chunk_hash, 64::bigint as dims, round(coalesce(v.total, 0), 4) as vector_sum
      from doc_pieces p left join (select repo, chunk_hash, sum(round(value, 4)) as total from doc_vectors group by all) v
        on v.repo = p.repo and v.chunk_hash = p.chunk_hash""",
    "d7_branch_twice": f"""
      select *, chunks as vectors from (
      select repo as repo_name, '' as branch, count(*) as chunks, count(distinct file_path) as sources
      from (select distinct repo, file_path, chunk from ({_windows('stored_files', 1000, 100)})) group by repo
      union all
      select repo, case when repo in (select repo from stored_files) then 'pr-1' else '' end, count(*), count(distinct file_path)
      from (select distinct w.repo, w.file_path, chunk from ({_windows('current_files', 1000, 100)}) w
            join changes c on c.repo = w.repo and c.file_path = w.file_path and c.change in ('new', 'changed')) group by repo)""",
    "d7_branch_removed": f"""
      select * from (
      select repo as repo_name, '' as branch, count(*) as chunks, count(distinct file_path) as sources
      from (select distinct repo, file_path, chunk from ({_windows('stored_files', 1000, 100)})) group by repo
      union all
      select repo, case when repo in (select repo from stored_files) then 'pr-1' else '' end, count(*), count(distinct file_path)
      from (select distinct w.repo, w.file_path, chunk from ({_windows('current_files', 1000, 100)}) w
            join changes c on c.repo = w.repo and c.file_path = w.file_path and c.change in ('new', 'changed')) group by repo) where branch = ''""",
    "d9_file_contexts": """
      with t as (select query_id, source, string_split(file_text, chr(10)) as lines from grouped where length(file_text) > 6000),
      r as (select h.query_id, h.source, greatest(0, start_line - 21) as a, least(len(lines), end_line + 20) as b
            from good_hits h join t on t.query_id = h.query_id and t.source = h.source),
      m as (select *, max(b) over (partition by query_id, source order by a, b rows between unbounded preceding and 1 preceding) as before
            from r where a < b),
      i as (select *, sum(case when before is null or a > before then 1 else 0 end) over (partition by query_id, source order by a, b rows unbounded preceding) as island from m),
      u as (select query_id, source, min(a) as a, max(b) as b from i group by query_id, source, island),
      x as (select u.query_id, u.source, string_agg(array_to_string(lines[a + 1 : b], chr(10)),
              concat(chr(10), chr(10), '... (content omitted) ...', chr(10), chr(10)) order by a) as body
            from u join t on t.query_id = u.query_id and t.source = u.source group by u.query_id, u.source)
      select g.query_id, g.source, relevance_score, language, coalesce(symbols, '') as symbols, found, length(file_text) > 6000 as truncated,
        md5(concat('[Archivo: ', g.source,
          case when s.n is null then '' else concat(case when s.n = 1 then ' | Funcion: ' else ' | Funciones: ' end, s.shown) end, ']', chr(10),
          case when length(file_text) <= 6000 then file_text
            when length(coalesce(body, file_text)) > 6000 then concat(left(coalesce(body, file_text), 6000), chr(10), '... (truncated)')
            else body end)) as content_md5
      from grouped g left join symbol_lists s on s.query_id = g.query_id and s.source = g.source
      left join x on x.query_id = g.query_id and x.source = g.source""",
    "d10_configured_check": f"""
      with {_CONFIGURED}
      select query_id, task_id, rule_idx, verdict, explanation, llm_provider, tokens_used,
        case when kind = 1 then primary_verdict end as primary_verdict, case when kind = 1 then secondary_verdict end as secondary_verdict,
        case when kind = 1 then not differ end as agreement, case when kind = 1 then differ end as discriminator_used,
        case when differ then 'judge' end as discriminator_model, round(score, 6) as score, approval_threshold, score >= approval_threshold as approved from s""",
    "d10_result_documents": f"""
      with {_CONFIGURED},
      f as (select query_id, count(*) as files, sum(length(file_content)) as chars from doc_contexts group by query_id)
      select task_id, 0::bigint as part, row_number() over (partition by task_id order by rule_idx) - 1 as place, md5(rule_text) as rule_md5, verdict, tokens_used,
        not differ as agreement, coalesce(files, 0) as files, coalesce(chars, 0)::bigint as chars from s left join f on f.query_id = s.query_id""",
    "e3_second_chunker": "select query_id, source, count(*) as hits, round(max(similarity), 4) as relevance_score from doc_hits_wide group by query_id, source",
    "e4_index_commit": f"""
      select f.repo, f.file_path, sha256(f.content) as content_hash, coalesce(n, 0) as chunks, coalesce(n, 0) as vectors from current_files f
      left join (select repo, file_path, count(distinct chunk) as n from ({_windows('current_files', 1000, 100)}) group by all) w on w.repo = f.repo and w.file_path = f.file_path""",
    "d11_cross_check": """
      select primary_verdict, secondary_verdict, adjudicated_verdict, agreement, discriminator_used, final_verdict,
        case when not agreement and not discriminator_used then 'Discriminator unavailable: no answer' end as discriminator_reasoning, count(*) as n
      from final group by all""",
    "d11_joined_cross_check": "select task_id, rule_idx, agreement, discriminator_used, final_verdict from final",
    "d12_adjudication_prompts": f"""
      select task_id, rule_idx, md5({_adjudication('rule', 'primary_verdict', 'explanation', 'secondary_verdict', "concat('Other: ', explanation)")}) as prompt_md5
      from lines where primary_verdict <> secondary_verdict""",
    "r1_admission": """
      with existing as (select repository_full_name, pr_number, count(*) as n from pr_events where action = 'closed' group by all),
      has_rules as (select distinct user_id, repository_full_name from rules),
      j as (select e.*, o.user_id, coalesce(c.pr_evaluation_enabled, true) as enabled, coalesce(c.max_evaluations_per_pr, 3) as cap,
              h.user_id is not null as has_rules, coalesce(x.n, 0) as n
            from pr_events e left join owners o on o.repository_full_name = e.repository_full_name
            left join repo_configs c on c.user_id = o.user_id and c.repository_full_name = e.repository_full_name
            left join has_rules h on h.user_id = o.user_id and h.repository_full_name = e.repository_full_name
            left join existing x on x.repository_full_name = e.repository_full_name and x.pr_number = e.pr_number),
      p as (select *, case when action not in ('opened', 'synchronize', 'reopened') then 'action not handled' when user_id is null then 'no owner'
              when not enabled then 'disabled' end as early from j),
      k as (select *, row_number() over (partition by repository_full_name, pr_number, early is null and has_rules order by ts, event_id) as r from p),
      d as (select *, case when early is not null then early when has_rules and n + r > cap then 'max evaluations reached'
              when not has_rules and n >= cap then 'max evaluations reached' when not has_rules then 'no rules' end as reason from k)
      select event_id, reason is null as admitted, reason, case when reason is null then n + r end::double as eval_no from d""",
    "r2_task_state": """
      select task_id, arg_max(status, (ts, event_id)) as status, (arg_max(progress, (ts, event_id)) filter (where progress is not null))::double as progress,
        arg_max(message, (ts, event_id)) filter (where message is not null) as message, count(*) as events
      from task_events group by task_id""",
    "r3_calls_per_minute": "select user_id as caller, date_trunc('minute', ts)::timestamp as minute, count(*) as calls, count(*) > 10 as over_limit from events group by 1, 2",
    "r4_sliding_rate": f"""
      select user_id as caller, window_start, count(*) as calls, count(*) > 1 as over_limit
      from (select user_id, {_HOUR10} - to_seconds(unnest(range(6)) * 10) as window_start from events) group by all""",
    "r5_requeue": """
      with f as (select id, case id % 3 when 0 then 'LLM' when 1 then 'EMBEDDING' else 'OTHER' end as kind, retry_count, completed_at,
              coalesce(error, 'unknown') as technical,
              id % 3 < 2 and retry_count < 5 as again from tasks where status = 'failed')
      select id as task_id, case when again then 'pending' else 'failed' end as status, case when again then retry_count + 1 else retry_count end as retry_count,
        case when again then completed_at + interval 120 second end as retry_after,
        case when again then 'Service temporarily unavailable. Evaluation will resume automatically.' end as progress_message,
        case when again then null else to_json({code: case kind when 'OTHER' then 'UNEXPECTED_ERROR' else concat(kind, '_UNAVAILABLE') end,
          message: case kind when 'LLM' then 'LLM service did not respond after 5 attempts. Please try again later.'
            when 'EMBEDDING' then 'Vector search service did not respond after 5 attempts. Please try again later.'
            else 'An unexpected error occurred during evaluation. Contact support if the issue persists.' end,
          technical: technical})::varchar end as error from f""",
    "r6_hourly_activity": "select date_trunc('hour', created_at)::timestamp as hour, status, count(*) as n from activity group by 1, 2",
    "r7_routing": """
      with conn as (select distinct user_id, unnest([user_id * 2, user_id * 2 + 1]) as connection_id from task_events),
      sub as (select distinct user_id * 2 + 1 as connection_id, task_id from task_events where type = 'task_requeued')
      select event_id, connection_id from task_events e join conn c on c.user_id = e.user_id
      where not exists (select 1 from sub s where s.connection_id = c.connection_id)
         or exists (select 1 from sub s where s.connection_id = c.connection_id and s.task_id = e.task_id)""",
    "r8_installations": """
      with a as (select event_id, ts, e.user_id % 40 as installation_id, event_type, concat('org', e.user_id) as account_login, u.user_id as known
            from events e left join users u on u.login = concat('user', event_id % 9)
            where event_type in ('error', 'click') or (event_type in ('purchase', 'view') and u.user_id is not null)),
      l as (select installation_id, arg_max(event_type, (ts, event_id)) as last_type, arg_max(account_login, (ts, event_id)) as account_login,
            max((ts, event_id)) filter (where event_type in ('error', 'click')) as removed from a group by installation_id)
      select l.installation_id, arg_min(a.known, (a.ts, a.event_id)) as user_id, l.account_login
      from l join a on a.installation_id = l.installation_id and a.event_type in ('purchase', 'view')
        and (l.removed is null or (a.ts, a.event_id) > l.removed)
      where l.last_type in ('purchase', 'view') group by l.installation_id, l.account_login""",
}

LAYERED = {
    "w4_layers_last": _layers("similarity asc, chunk_hash desc"),
    "w4_layers_best": _layers("similarity desc, chunk_hash asc"),
    "w4_layers_masked": _layers(
        "similarity asc, chunk_hash desc",
        "(branch <> '' or (collection_name, source) not in (select (collection_name, source) from stale))",
    ),
    "d8_semantic_search": _layers("similarity asc, chunk_hash desc", "language = 'python'", 10, "similarity >= 0.1"),
}


def _merge_ctes(body: str) -> str:
    """Join the views with the CTEs that a body brings along."""
    own = re.match(r"\s*with\s+", body)
    if not own:
        return _with(body)
    rest = body[own.end():]
    views = _with(rest)
    return views.replace("\n" + rest, ",\n" + rest, 1) if views != rest else body


ORACLES: dict[str, str] = {name: _merge_ctes(sql) for name, sql in {**BODIES, **LAYERED}.items()}
