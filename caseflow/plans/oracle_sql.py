"""The registered queries in plain SQL, used only to check results.

Each query lists the shared tables it needs; ``statement`` prepends those and whatever they need.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2001-08-03 00:00:00'"

TABLES: dict[str, tuple[list[str], str]] = {
    "domains": ([], """
        SELECT r_regionkey::BIGINT AS id, lower(r_name) AS slug, r_name AS name, r_regionkey <> 4 AS is_active FROM region"""),
    "segments": ([], """
        SELECT * FROM (VALUES ('automobile',1,48),('building',2,72),('furniture',3,96),('household',4,120),('machinery',5,24)) v(slug,n,sla)"""),
    "categories": (["segments"], """
        SELECT r_regionkey::BIGINT * 10 + n AS id, r_regionkey::BIGINT AS domain_id, slug, upper(slug) AS name, sla::INTEGER AS sla_hours
        FROM region, segments"""),
    "lines": ([], "SELECT l_orderkey, sum(l_quantity) AS quantity, min(l_suppkey) AS first_supplier FROM lineitem GROUP BY 1"),
    "firsts": ([], "SELECT o_custkey, min(o_orderkey) AS first_id FROM orders GROUP BY 1"),
    "base": (["firsts"], """
        SELECT o_orderkey AS id, o_custkey AS submitted_by, o_orderstatus, n_regionkey::BIGINT AS domain_id, lower(c_mktsegment) AS segment,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority,
          o_orderdate + to_hours((o_orderkey % 24)::INTEGER) AS created_at,
          CASE WHEN o_orderkey % 17 = 0 AND o_orderkey <> first_id THEN first_id END AS duplicate_of
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN firsts USING (o_custkey)"""),
    "triaged": (["base", "segments"], """
        SELECT b.*, CASE WHEN priority IS NOT NULL THEN segment END AS category_slug, CASE WHEN priority IS NOT NULL THEN domain_id * 10 + n END AS category_id,
          CASE WHEN priority IS NOT NULL THEN sla::INTEGER END AS sla_hours,
          CASE WHEN priority IS NOT NULL THEN created_at + to_hours((id % 48)::INTEGER) END AS triaged_at
        FROM base b LEFT JOIN segments s ON s.slug = b.segment"""),
    "staged": (["triaged", "lines"], """
        SELECT t.*, l.*, triaged_at + to_hours(sla_hours) AS due_at,
          CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN priority IS NULL THEN 'submitted'
            WHEN o_orderstatus = 'F' AND quantity IS NOT NULL THEN CASE WHEN id % 2 = 0 THEN 'closed' ELSE 'resolved' END
            WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'in_review' END AS status
        FROM triaged t LEFT JOIN lines l ON l_orderkey = id"""),
    "complaints": (["staged"], """
        SELECT id, domain_id, category_id, category_slug, sla_hours, priority, status, submitted_by,
          CASE WHEN status IN ('in_progress','resolved','closed') THEN first_supplier END AS assignee_id, duplicate_of, created_at, triaged_at, due_at,
          CASE WHEN status IN ('resolved','closed') THEN triaged_at + to_hours(quantity::INTEGER) END AS resolved_at
        FROM staged"""),
    "texts": ([], "SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 300) AS title, text AS body FROM documents"),
    "titled": (["complaints", "texts"], """
        SELECT c.*, title, body FROM complaints c LEFT JOIN texts ON doc_id = c.id % (SELECT count(*) FROM documents)"""),
    "damaged": (["complaints"], """
        SELECT * REPLACE (
          CASE WHEN id > 0 AND (id % 101 = 0 OR (id % 103 <> 0 AND (id % 107 = 0 OR id BETWEEN 1 AND 20))) THEN 'duplicate' ELSE status END AS status,
          CASE WHEN id <= 0 THEN duplicate_of WHEN id % 101 = 0 THEN NULL WHEN id % 103 = 0 THEN id
            WHEN id % 107 = 0 OR id BETWEEN 1 AND 20 THEN id - 1 ELSE duplicate_of END AS duplicate_of,
          CASE WHEN id % 109 = 0 THEN due_at + to_hours(1) ELSE due_at END AS due_at,
          CASE WHEN id % 113 = 0 THEN category_id + 10 ELSE category_id END AS category_id,
          CASE WHEN id % 127 = 0 THEN 'urgent' ELSE priority END AS priority,
          CASE WHEN id % 131 = 0 THEN assignee_id + 1000000000 ELSE assignee_id END AS assignee_id) FROM complaints"""),
    "batch": (["complaints"], "SELECT id * 10 + CASE WHEN id % 3 = 0 THEN 1 ELSE 9 END AS id FROM complaints WHERE category_slug IS NOT NULL"),
    "export": ([], "SELECT CASE WHEN doc_id % 97 <> 5 THEN md5(text) END AS external_id, doc_id, n_chars, source FROM documents"),
    "keyed_intake": (["validated"], "SELECT id, title, CASE WHEN id % 29 <> 3 THEN submitted_by END AS submitted_by, domain_id FROM validated WHERE reason IS NULL"),
    "looped": (["damaged"], """
        SELECT id, CASE WHEN id % 1000 = 0 THEN id + 1 WHEN id % 1000 IN (1, 2) THEN id - 1 ELSE duplicate_of END AS duplicate_of FROM damaged"""),
    # Sixty steps are more than any chain has; what still moves then is on a cycle or leads to one.
    "chains": (["looped"], """
        SELECT id, duplicate_of AS root, 1::BIGINT AS hops FROM looped WHERE duplicate_of IS NOT NULL AND duplicate_of <> id
        UNION ALL SELECT c.id, d.duplicate_of, c.hops + 1 FROM chains c JOIN looped d ON d.id = c.root WHERE d.duplicate_of IS NOT NULL AND d.duplicate_of <> d.id AND c.hops < 60"""),
    "users": ([], "SELECT c_custkey AS id, c_name AS username, c_custkey = 0 AS is_superuser, c_acctbal FROM customer"),
    "elevated": ([], """
        SELECT c_custkey AS user_id, CASE WHEN c_custkey % 20 = 0 THEN 'Admin' ELSE 'Agent' END AS group_name FROM customer WHERE c_custkey % 20 <= 3"""),
    "user_groups": (["elevated"], """
        SELECT user_id, group_name FROM elevated
        UNION ALL SELECT c_custkey, 'Submitter' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM elevated)"""),
    "all_permissions": ([], """
        SELECT * FROM (VALUES ('complaints.add_complaint',0),('complaints.view_complaint',0),('complaints.view_queue',1),('complaints.change_complaint',1),
          ('complaints.triage_complaint',1),('complaints.assign_complaint',1),('complaints.resolve_complaint',1),('complaints.mark_duplicate',1),
          ('domains.manage_domain',2),('complaints.view_ml_metrics',2)) v(permission, level)"""),
    "grants": (["user_groups", "all_permissions", "users"], """
        SELECT user_id, permission FROM user_groups JOIN all_permissions ON level <= CASE group_name WHEN 'Submitter' THEN 0 WHEN 'Agent' THEN 1 ELSE 2 END
        UNION SELECT c_custkey, 'complaints.view_queue' FROM customer WHERE c_custkey % 97 = 0
        UNION SELECT id, permission FROM users, all_permissions WHERE is_superuser"""),
    "suggested": (["complaints"], """
        SELECT *, CASE WHEN id % 10 < 6 THEN category_slug WHEN id % 10 < 9 THEN ['automobile','building','furniture','household','machinery'][(id % 5 + 1)] END AS slug,
          ((id * 7919) % 1000) / 1000.0::DOUBLE AS score FROM complaints"""),
    "predictions": (["suggested"], """
        SELECT id * 10 + 1 AS id, id AS complaint_id, domain_id, 'triage' AS kind, slug, ((id % 100) / 100.0::DOUBLE) AS confidence, NULL::BIGINT AS match_id, NULL::DOUBLE AS score,
          CASE WHEN id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version, created_at + to_hours(1) AS created_at FROM suggested WHERE category_slug IS NOT NULL AND id % 3 <> 0
        UNION ALL SELECT id * 10 + 2, id, domain_id, 'dedup', NULL, NULL, CASE WHEN id % 4 <> 0 THEN duplicate_of ELSE id + 1 END, NULL, 'v1', created_at + to_hours(1) FROM suggested WHERE duplicate_of IS NOT NULL
        UNION ALL SELECT id * 10 + 3, id, domain_id, 'risk', NULL, NULL, NULL, score, 'v1', triaged_at FROM suggested WHERE category_slug IS NOT NULL
        UNION ALL SELECT id * 10 + 4, id, domain_id, 'triage', slug, ((id % 100) / 100.0::DOUBLE), NULL, NULL, 'v0', CASE WHEN id % 10 = 0 THEN created_at + to_hours(1) ELSE created_at END
          FROM suggested WHERE category_slug IS NOT NULL AND id % 3 <> 0 AND id % 5 = 0"""),
    "latest": (["predictions"], """
        SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY complaint_id, kind ORDER BY created_at DESC, id DESC) = 1"""),
    "history": (["complaints"], """
        SELECT e.id, c.id AS complaint_id, domain_id, e.kind, from_value, to_value, CASE WHEN c.id % 11 <> 0 THEN submitted_by END AS actor_id, prediction_id, note, moment AS created_at FROM complaints c, LATERAL (
          SELECT c.id * 10 + 1 AS id, 'category' AS kind, NULL::VARCHAR AS from_value, c.category_slug AS to_value, CASE WHEN c.id % 3 <> 0 THEN c.id * 10 + 1 WHEN c.id % 29 = 0 THEN c.id * 10 + 3 END AS prediction_id, '' AS note, c.triaged_at AS moment WHERE c.category_slug IS NOT NULL
          UNION ALL SELECT c.id * 10 + 2, 'priority', NULL, c.priority, NULL, '', c.triaged_at WHERE c.category_slug IS NOT NULL
          UNION ALL SELECT c.id * 10 + 3, 'status', 'submitted', 'in_review', NULL, 'Triaged', c.triaged_at WHERE c.category_slug IS NOT NULL
          UNION ALL SELECT c.id * 10 + 4, 'status', 'in_review', 'in_progress', NULL, '', c.triaged_at + to_hours(1) WHERE c.status IN ('in_progress','resolved','closed')
          UNION ALL SELECT c.id * 10 + 5, 'status', 'in_progress', 'resolved', NULL, '', greatest(c.resolved_at, c.triaged_at + to_hours(1)) WHERE c.resolved_at IS NOT NULL
          UNION ALL SELECT c.id * 10 + 6, 'status', 'resolved', 'closed', NULL, '', greatest(c.resolved_at, c.triaged_at + to_hours(1)) + to_hours(1) WHERE c.status = 'closed'
          UNION ALL SELECT c.id * 10 + 7, 'status', CASE WHEN c.category_slug IS NULL THEN 'submitted' ELSE 'in_review' END, 'duplicate', NULL, '', coalesce(c.triaged_at, c.created_at) + to_hours(72) WHERE c.duplicate_of IS NOT NULL
          UNION ALL SELECT c.id * 10 + 8, 'duplicate', NULL, c.duplicate_of::VARCHAR, c.id * 10 + 2, '', coalesce(c.triaged_at, c.created_at) + to_hours(72) WHERE c.duplicate_of IS NOT NULL) e"""),
    "judged": (["history", "predictions"], """
        SELECT h.*, p.kind AS prediction_kind, p.model_version,
          CASE WHEN p.kind = 'triage' THEN p.slug IS NOT DISTINCT FROM h.to_value WHEN p.kind = 'dedup' THEN coalesce(p.match_id::VARCHAR = h.to_value, FALSE) END AS accepted
        FROM history h LEFT JOIN predictions p ON p.id = h.prediction_id"""),
    "parsed": ([], """
        SELECT event_id, ts, event_type, user_id * 8 + event_id % 8 AS complaint_id, json_extract_string(props, '$.k')::BIGINT AS k,
          (user_id * 8 + event_id % 8) % 5 AS domain_id FROM events"""),
    "commands": (["parsed"], """
        SELECT event_id AS seq, ts, complaint_id, domain_id,
          CASE WHEN event_type = 'view' THEN 'triage' WHEN event_type = 'error' AND k < 15 THEN 'mark_duplicate' WHEN event_type = 'error' THEN 'assign' ELSE 'transition' END AS op,
          CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'resolved' WHEN 'signup' THEN 'closed' END AS to_status,
          CASE WHEN event_type = 'view' THEN CASE WHEN k >= 90 THEN (domain_id + 1) % 5 ELSE domain_id END * 10 + k % 5 + 1 END AS category_id,
          CASE WHEN event_type = 'view' THEN CASE WHEN k BETWEEN 85 AND 89 THEN 'urgent' ELSE ['low','medium','high','critical'][(k % 4 + 1)] END END AS priority,
          CASE WHEN event_type = 'error' AND k >= 15 THEN 'agent' || (k % 7) END AS assignee,
          CASE WHEN event_type = 'error' AND k < 15 THEN CASE WHEN k < 10 THEN complaint_id + 5 * (k + 1) WHEN k % 2 = 0 THEN complaint_id ELSE complaint_id + 1 END END AS canonical_id,
          event_id % 50 AS actor_id FROM parsed"""),
    "access": (["commands", "users", "grants"], """
        SELECT *, CASE
          WHEN (actor_id, CASE WHEN op = 'triage' OR (op = 'transition' AND to_status IN ('in_review', 'in_progress')) THEN 'complaints.triage_complaint' WHEN op = 'assign' THEN 'complaints.assign_complaint'
            WHEN op = 'mark_duplicate' THEN 'complaints.mark_duplicate' ELSE 'complaints.resolve_complaint' END) NOT IN (SELECT (user_id, permission) FROM grants) THEN 'forbidden'
          WHEN complaint_id // 8 NOT IN (SELECT id FROM users) OR NOT (complaint_id // 8 = actor_id OR actor_id IN (SELECT user_id FROM grants WHERE permission = 'complaints.view_queue')) THEN 'not_found'
          WHEN op = 'assign' AND assignee NOT IN ('agent0','agent1','agent2','agent3','agent4') THEN 'unknown_assignee' END AS denied FROM commands"""),
    "permitted_commands": (["access"], "SELECT * EXCLUDE (denied) FROM access WHERE denied IS NULL"),
    "checked": (["commands", "categories"], """
        SELECT m.*, c.slug AS category_slug, c.sla_hours,
          CASE WHEN op = 'triage' THEN CASE WHEN c.domain_id IS NULL THEN 'unknown_category' WHEN c.domain_id <> m.domain_id THEN 'foreign_category'
            WHEN m.priority NOT IN ('low','medium','high','critical') THEN 'unknown_priority' END END AS refusal
        FROM commands m LEFT JOIN categories c ON c.id = m.category_id"""),
    "numbered": (["checked"], """
        SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY ts, seq) AS rn FROM checked WHERE op <> 'mark_duplicate'"""),
    # Sequential interpreter: one command per complaint and recursion step.
    "folded": (["numbered"], """
        SELECT complaint_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS op, 'submitted' AS status_before, 'submitted' AS status, NULL::VARCHAR AS reason,
          NULL::VARCHAR AS old_slug, NULL::VARCHAR AS slug, NULL::VARCHAR AS old_priority, NULL::VARCHAR AS priority, NULL::INTEGER AS sla, NULL::VARCHAR AS old_assignee, NULL::VARCHAR AS assignee,
          NULL::TIMESTAMP AS triaged_at, NULL::TIMESTAMP AS resolved_at, NULL::TIMESTAMP AS ts, NULL::BIGINT AS actor_id, NULL::BIGINT AS category_id
        FROM (SELECT DISTINCT complaint_id FROM numbered)
        UNION ALL
        SELECT n.complaint_id, n.rn, n.seq, n.op, f.status,
          CASE WHEN n.op = 'triage' AND n.refusal IS NULL AND f.status = 'submitted' THEN 'in_review'
               WHEN n.op = 'transition' AND (f.status, n.to_status) IN (('in_review','in_progress'),('in_progress','resolved'),('resolved','closed'),('resolved','in_progress')) THEN n.to_status ELSE f.status END,
          CASE WHEN n.op = 'triage' THEN n.refusal
               WHEN n.op = 'transition' AND (f.status, n.to_status) NOT IN (('in_review','in_progress'),('in_progress','resolved'),('resolved','closed'),('resolved','in_progress')) THEN 'illegal_transition' END,
          f.slug, CASE WHEN n.op = 'triage' AND n.refusal IS NULL THEN n.category_slug ELSE f.slug END,
          f.priority, CASE WHEN n.op = 'triage' AND n.refusal IS NULL THEN n.priority ELSE f.priority END,
          CASE WHEN n.op = 'triage' AND n.refusal IS NULL THEN n.sla_hours ELSE f.sla END,
          f.assignee, CASE WHEN n.op = 'assign' THEN n.assignee ELSE f.assignee END,
          CASE WHEN n.op = 'triage' AND n.refusal IS NULL THEN coalesce(f.triaged_at, n.ts) ELSE f.triaged_at END,
          CASE WHEN n.op = 'transition' AND f.status = 'in_progress' AND n.to_status = 'resolved' THEN coalesce(f.resolved_at, n.ts) ELSE f.resolved_at END,
          n.ts, n.actor_id, CASE WHEN n.op = 'triage' AND n.refusal IS NULL THEN n.category_id ELSE f.category_id END
        FROM folded f JOIN numbered n ON n.complaint_id = f.complaint_id AND n.rn = f.rn + 1"""),
    "marks": (["commands", "folded"], """
        SELECT *, row_number() OVER (ORDER BY ts, seq) AS n FROM (
          SELECT m.seq, m.ts, m.complaint_id, m.domain_id, m.canonical_id, coalesce(arg_max(f.status, f.rn), 'submitted') AS base, m.canonical_id IN (SELECT complaint_id FROM commands) AS known
          FROM commands m LEFT JOIN folded f ON f.complaint_id = m.complaint_id AND (f.ts < m.ts OR (f.ts = m.ts AND f.seq < m.seq)) WHERE m.op = 'mark_duplicate' GROUP BY ALL)"""),
    # All marks in time order, carrying the list of duplicates so far.
    "walk": (["marks"], """
        SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::TIMESTAMP AS ts, NULL::BIGINT AS complaint_id, NULL::BIGINT AS canonical_id, NULL::VARCHAR AS status_before, NULL::VARCHAR AS reason, []::BIGINT[] AS dups
        UNION ALL
        SELECT n, seq, ts, complaint_id, canonical_id, status_before, reason, CASE WHEN reason IS NULL THEN list_append(dups, complaint_id) ELSE dups END FROM (
          SELECT m.n, m.seq, m.ts, m.complaint_id, m.canonical_id, w.dups, CASE WHEN list_contains(w.dups, m.complaint_id) THEN 'duplicate' ELSE m.base END AS status_before,
            CASE WHEN NOT known THEN 'unknown_canonical' WHEN m.canonical_id = m.complaint_id THEN 'self_duplicate' WHEN list_contains(w.dups, m.canonical_id) THEN 'canonical_is_duplicate'
              WHEN m.canonical_id % 5 <> m.domain_id THEN 'cross_domain' WHEN list_contains(w.dups, m.complaint_id) OR m.base NOT IN ('submitted','in_review','in_progress') THEN 'status' END AS reason
          FROM walk w JOIN marks m ON m.n = w.n + 1)"""),
    # Commands after an accepted mark: no transition is legal any more.
    "marked": (["folded", "walk"], """
        SELECT * EXCLUDE (late) REPLACE (CASE WHEN late THEN 'duplicate' ELSE status_before END AS status_before, CASE WHEN late THEN 'duplicate' ELSE status END AS status,
          CASE WHEN late AND op = 'transition' THEN 'illegal_transition' ELSE reason END AS reason)
        FROM (SELECT f.*, coalesce(f.ts > w.ts OR (f.ts = w.ts AND f.seq > w.seq), FALSE) AS late FROM folded f LEFT JOIN (SELECT complaint_id, ts, seq FROM walk WHERE reason IS NULL AND seq IS NOT NULL) w USING (complaint_id))"""),
    "ended": (["folded", "walk"], """
        SELECT m.complaint_id, m.complaint_id % 5 AS domain_id, CASE WHEN w.seq IS NOT NULL THEN 'duplicate' ELSE coalesce(f.status, 'submitted') END AS status, f.category_id, f.slug AS category_slug, f.priority, f.assignee,
          w.canonical_id AS duplicate_of, f.triaged_at, f.triaged_at + to_hours(f.sla) AS due_at, CASE WHEN w.seq IS NULL OR f.resolved_at < w.ts THEN f.resolved_at END AS resolved_at
        FROM (SELECT DISTINCT complaint_id FROM commands) m
          LEFT JOIN (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY rn DESC) = 1) f USING (complaint_id)
          LEFT JOIN (SELECT * FROM walk WHERE reason IS NULL AND seq IS NOT NULL) w USING (complaint_id)"""),
    "graded": (["latest", "complaints"], """
        SELECT p.complaint_id, c.category_slug AS label, coalesce(p.slug, '(abstained)') AS predicted FROM latest p JOIN complaints c ON c.id = p.complaint_id WHERE p.kind = 'triage'"""),
    "shortlists": (["complaints"], """
        SELECT id, category_slug AS label, id % 5 AS shift, CASE category_slug WHEN 'automobile' THEN 0 WHEN 'building' THEN 1 WHEN 'furniture' THEN 2 WHEN 'household' THEN 3 ELSE 4 END AS place
        FROM complaints WHERE category_slug IS NOT NULL"""),
    "ranked": (["predictions", "complaints"], """
        SELECT p.complaint_id AS id, p.score, c.resolved_at > c.due_at AS label FROM predictions p JOIN complaints c ON c.id = p.complaint_id WHERE p.kind = 'risk' AND c.resolved_at IS NOT NULL"""),
    "confusion": (["graded"], "SELECT label, predicted, count(*) AS n FROM graded GROUP BY ALL"),
    "per_class": (["confusion"], """
        SELECT k AS class, coalesce(tp, 0)::BIGINT AS true_positives, coalesce(np, 0)::BIGINT AS n_predicted, coalesce(nl, 0)::BIGINT AS n_labelled,
          coalesce(tp / nullif(np, 0), 0.0) AS precision_raw, coalesce(tp / nullif(nl, 0), 0.0) AS recall_raw FROM
          (SELECT label AS k FROM confusion UNION SELECT predicted FROM confusion WHERE predicted <> '(abstained)')
          LEFT JOIN (SELECT label AS k, sum(n)::DOUBLE AS nl, sum(n) FILTER (WHERE label = predicted)::DOUBLE AS tp FROM confusion GROUP BY 1) USING (k)
          LEFT JOIN (SELECT predicted AS k, sum(n)::DOUBLE AS np FROM confusion GROUP BY 1) USING (k)"""),
    "scored_classes": (["per_class"], """
        SELECT *, CASE WHEN precision_raw + recall_raw > 0 THEN 2 * precision_raw * recall_raw / (precision_raw + recall_raw) ELSE 0.0 END AS f1_raw FROM per_class"""),
    "auc": (["ranked"], """
        SELECT (sum(r) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2.0) / (count(*) FILTER (WHERE label)::DOUBLE * count(*) FILTER (WHERE NOT label)) AS value
        FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM ranked)"""),
    "tokens": ([], r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents"),
    "words": (["tokens"], """
        SELECT doc_id, 1::BIGINT AS n, w AS grams FROM tokens UNION ALL SELECT doc_id, 2, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) FROM tokens"""),
    "text_grams": (["words"], "SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(grams) AS gram FROM words) GROUP BY ALL"),
    "first_texts": (["tokens"], "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents JOIN tokens USING (doc_id) WHERE len(w) > 0"),
    "first_weights": (["text_grams", "first_texts"], """
        SELECT g.doc_id AS id, gram, tf * ln(((SELECT count(DISTINCT first) FROM first_texts) + 1) / (df + 1)) AS weight
        FROM text_grams g JOIN (SELECT gram, count(*) AS df FROM text_grams WHERE doc_id IN (SELECT first FROM first_texts) GROUP BY 1) USING (gram) WHERE g.doc_id IN (SELECT first FROM first_texts)"""),
    "first_vectors": (["first_weights"], "SELECT id, gram, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS x FROM first_weights"),
    "text_weights": (["text_grams"], "SELECT doc_id, tf * ln(((SELECT count(DISTINCT doc_id) FROM text_grams) + 1) / (count(*) OVER (PARTITION BY gram) + 1)) AS weight FROM text_grams"),
    "asked": (["first_texts"], "SELECT id, first FROM first_texts WHERE id % 20 = 0"),
    "sims": (["first_vectors", "asked"], """
        SELECT a.id AS a, b.id AS b, round(sum(a.x * b.x), 6) AS similarity FROM first_vectors a JOIN first_vectors b USING (gram) WHERE a.id IN (SELECT first FROM asked) AND a.id <> b.id GROUP BY ALL
          UNION ALL SELECT DISTINCT first, first, 1.0 FROM asked"""),
    "letters": ([], r"SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '\s+', ' ', 'g'), '(?s).') AS c FROM documents"),
    "chars": (["letters"], """
        SELECT doc_id, 3::BIGINT AS n, list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) AS grams FROM letters
        UNION ALL SELECT doc_id, 4, list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3]) FROM letters
        UNION ALL SELECT doc_id, 5, list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4]) FROM letters"""),
    "finance": ([], """
        SELECT doc_id::VARCHAR AS external_id, text, CASE lang WHEN 'en' THEN 'Mortgage' WHEN 'fr' THEN 'Credit card' WHEN 'de' THEN 'Debt collection' WHEN 'es' THEN 'Other' END AS category_label,
          TIMESTAMP '2024-01-01' + to_days((doc_id % 365)::INTEGER) AS submitted_at, NULL::TIMESTAMP AS resolved_at, CASE quality WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS sla_met
        FROM documents LEFT JOIN labels USING (doc_id) WHERE trim(text, ' ') <> ''"""),
    "civic": (["complaints"], """
        SELECT id::VARCHAR AS external_id, coalesce(category_slug, '') AS text, ['Noise','Street condition','Sanitation','Other'][(id % 4 + 1)] AS category_label, created_at AS submitted_at, resolved_at,
          resolved_at <= created_at + to_hours([24, 120, 48, 96][(id % 4 + 1)]) AS sla_met FROM complaints"""),
    "intake": (["domains"], """
        SELECT doc_id AS id, doc_id % 6 AS domain_id, doc_id * 7 % 1000 AS submitted_by, trim(split_part(text, chr(10), 1), ' ') AS title,
          trim(substr(text, length(split_part(text, chr(10), 1)) + 2), ' ') AS body FROM documents"""),
    "validated": (["intake", "domains"], """
        SELECT i.*, CASE WHEN i.title = '' THEN 'title_required' WHEN i.body = '' THEN 'body_required' WHEN d.id IS NULL THEN 'domain_unavailable' WHEN length(i.title) > 300 THEN 'title_too_long' END AS reason
        FROM intake i LEFT JOIN domains d ON d.id = i.domain_id AND d.is_active"""),
    "changes": (["complaints"], """
        SELECT domain_id, created_at AS moment, CASE WHEN status <> 'duplicate' THEN 1 ELSE 0 END AS delta FROM complaints
        UNION ALL SELECT domain_id, resolved_at, -1 FROM complaints WHERE resolved_at IS NOT NULL AND status <> 'duplicate'"""),
    "depths": (["changes"], """
        SELECT DISTINCT domain_id, moment, sum(delta) OVER (PARTITION BY domain_id ORDER BY moment RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM changes"""),
    "loads": (["complaints"], """
        SELECT DISTINCT assignee_id, moment, sum(delta) OVER (PARTITION BY assignee_id ORDER BY moment RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (
          SELECT assignee_id, triaged_at AS moment, 1 AS delta FROM complaints WHERE assignee_id IS NOT NULL AND status <> 'duplicate' AND triaged_at IS NOT NULL
          UNION ALL SELECT assignee_id, resolved_at, -1 FROM complaints WHERE assignee_id IS NOT NULL AND status <> 'duplicate' AND resolved_at IS NOT NULL)"""),
    "facts": (["complaints"], """
        SELECT category_id, resolved_at AS moment, epoch(resolved_at - triaged_at)::BIGINT AS s, (resolved_at > due_at)::INTEGER AS b, 1 AS n FROM complaints WHERE resolved_at IS NOT NULL"""),
    "past": (["facts", "complaints"], """
        SELECT id, category_id, coalesce(sum(n) OVER w, 0)::BIGINT AS n_resolved, sum(s) OVER w AS s, sum(b) OVER w AS b, probe FROM (
          SELECT NULL::BIGINT AS id, category_id, moment, s, b, n, FALSE AS probe FROM facts
          UNION ALL SELECT id, category_id, triaged_at, 0, 0, 0, TRUE FROM complaints WHERE category_id IS NOT NULL AND triaged_at IS NOT NULL)
        WINDOW w AS (PARTITION BY category_id ORDER BY moment RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""),
}

_DIGEST = """
        SELECT n, count(*) AS n_distinct, sum(tf)::BIGINT AS n_grams, sum(df)::BIGINT AS sum_df, max(df)::BIGINT AS max_df, sum(h)::VARCHAR AS sum_hash FROM (
          SELECT n, gram, sum(tf)::BIGINT AS tf, count(*) AS df, ('0x' || substr(md5(concat_ws(chr(31), gram, sum(tf)::BIGINT::VARCHAR, count(*)::VARCHAR)), 1, 15))::BIGINT::DECIMAL(38,0) AS h
          FROM (SELECT doc_id, n, gram, count(*) AS tf FROM (SELECT doc_id, n, unnest(grams) AS gram FROM {source}) GROUP BY ALL) GROUP BY n, gram) GROUP BY n"""

_C = "id, domain_id, category_id, category_slug, sla_hours, priority, status, submitted_by, assignee_id, duplicate_of, created_at, triaged_at, due_at, resolved_at"

QUERIES: dict[str, tuple[list[str], str]] = {
    "scan_complaints": (["complaints"], f"SELECT {_C} FROM complaints"),
    "ingest_finance": (["finance"], "SELECT * FROM finance"),
    "ingest_civic": (["civic"], "SELECT * FROM civic"),
    "ingest_idempotent": (["export"], """
        SELECT external_id, min(doc_id) AS doc_id, min(n_chars) AS n_chars FROM export
        WHERE external_id NOT IN (SELECT external_id FROM export WHERE external_id IS NOT NULL AND source IN ('src0','src1','src2')) GROUP BY 1"""),
    "ingest_rejects": (["export"], "SELECT external_id, doc_id, n_chars, 'external_id' AS missing FROM export WHERE external_id IS NULL"),
    "finance_tolerant": (["finance"], "SELECT * FROM finance WHERE external_id::BIGINT % 41 NOT IN (7, 8)"),
    "finance_rejects": ([], """
        SELECT doc_id::VARCHAR AS external_id, CASE doc_id % 41 WHEN 7 THEN 'n/a' ELSE '2024-02-31' END AS value, 'unreadable_date' AS reason FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 41 IN (7, 8)"""),
    "dataset_hash": ([], """
        SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, sum(h::DECIMAL(38,0))::VARCHAR AS sum_hash FROM (
          SELECT ('0x' || substr(md5(concat_ws(chr(31), doc_id::VARCHAR, text, lang, source)), 1, 15))::BIGINT AS h FROM documents)"""),
    "upsert_if_absent": (["keyed_intake"], """
        SELECT id, title, submitted_by FROM keyed_intake WHERE domain_id <= 1
        UNION ALL SELECT min(id), title, submitted_by FROM keyed_intake v WHERE submitted_by IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM keyed_intake w WHERE w.domain_id <= 1 AND w.title = v.title AND w.submitted_by = v.submitted_by) GROUP BY title, submitted_by"""),
    "upsert_rejects": (["keyed_intake"], "SELECT id, title, submitted_by, 'submitted_by' AS missing FROM keyed_intake WHERE submitted_by IS NULL"),
    "append_conflicts": (["predictions", "batch"], """
        SELECT id FROM (SELECT id FROM batch UNION ALL SELECT id FROM batch WHERE id % 50 = 19) WHERE id IN (SELECT id FROM predictions) OR id % 50 = 19"""),
    "cascade_delete": (["history", "predictions", "complaints"], """
        SELECT 'event' AS child, id, complaint_id FROM history WHERE complaint_id NOT IN (SELECT id FROM complaints WHERE status = 'closed')
        UNION ALL SELECT 'prediction', id, complaint_id FROM predictions WHERE complaint_id NOT IN (SELECT id FROM complaints WHERE status = 'closed')"""),
    "set_null_on_delete": (["complaints", "users"], """
        SELECT id, CASE WHEN assignee_id NOT IN (SELECT id FROM users WHERE c_acctbal < 0) THEN assignee_id END AS assignee_id,
          CASE WHEN duplicate_of NOT IN (SELECT id FROM complaints WHERE status = 'closed') THEN duplicate_of END AS duplicate_of FROM complaints"""),
    "protected_delete": (["complaints", "users", "categories", "domains"], """
        SELECT 'user' AS entity, id FROM users WHERE id IN (SELECT submitted_by FROM complaints)
        UNION ALL SELECT 'category', id FROM categories WHERE id IN (SELECT category_id FROM complaints WHERE category_id IS NOT NULL)
        UNION ALL SELECT 'domain', id FROM domains WHERE id IN (SELECT domain_id FROM complaints)"""),
    "pack_categories": (["finance", "civic"], """
        SELECT v.*, coalesce(n, 0)::BIGINT AS n_records FROM (VALUES ('cfpb','mortgage','Mortgage',72),('cfpb','credit_card','Credit card',48),('cfpb','debt_collection','Debt collection',72),('cfpb','other','Other',96),
          ('nyc311','noise','Noise',24),('nyc311','street_condition','Street condition',120),('nyc311','sanitation','Sanitation',48),('nyc311','other','Other',96)) v(domain_slug, category_slug, category_name, sla_hours)
        LEFT JOIN (SELECT 'cfpb' AS domain_slug, category_label AS category_name, count(*) AS n FROM finance GROUP BY ALL
          UNION ALL SELECT 'nyc311', category_label, count(*) FROM civic GROUP BY ALL) USING (domain_slug, category_name)"""),
    "complaint_view": (["titled", "users"], f"""
        SELECT t.id, domain_id AS domain, category_id AS category, priority, status, title, body, username AS submitted_by, assignee_id AS assignee, duplicate_of, created_at, triaged_at, due_at, resolved_at,
          coalesce(due_at < {AS_OF} AND resolved_at IS NULL, FALSE) AS is_overdue FROM titled t JOIN users u ON u.id = t.submitted_by"""),
    "overdue": (["complaints"], f"SELECT id, status, due_at FROM complaints WHERE resolved_at IS NULL AND due_at < {AS_OF}"),
    "my_complaints": (["complaints"], """
        SELECT *, ceil(pos / 25.0)::BIGINT AS page FROM (SELECT submitted_by AS user_id, id, domain_id, status, row_number() OVER (PARTITION BY submitted_by ORDER BY created_at DESC, id DESC) AS pos FROM complaints)"""),
    "agent_queue": (["complaints", "domains"], f"""
        SELECT c.id, d.slug AS domain_slug, category_slug, status, assignee_id, created_at, due_at, coalesce(due_at < {AS_OF} AND resolved_at IS NULL, FALSE) AS is_overdue,
          row_number() OVER (ORDER BY due_at ASC NULLS FIRST, created_at DESC, c.id DESC) AS pos
        FROM complaints c JOIN domains d ON d.id = c.domain_id WHERE status NOT IN ('closed','duplicate')"""),
    "intake_validate": (["validated"], "SELECT id, domain_id, submitted_by, title, body, reason IS NULL AS accepted, reason FROM validated"),
    "triage_validate": (["checked"], "SELECT seq, complaint_id, category_id, priority, refusal FROM checked WHERE op = 'triage'"),
    "unknown_refs": (["damaged", "categories", "domains", "users", "commands"], """
        SELECT 'assignee' AS reference, count(*) AS n_missing FROM damaged WHERE assignee_id IS NOT NULL AND assignee_id NOT IN (SELECT id FROM users)
        UNION ALL SELECT 'canonical', count(*) FROM commands WHERE canonical_id IS NOT NULL AND canonical_id NOT IN (SELECT complaint_id FROM commands)
        UNION ALL SELECT 'category', count(*) FROM damaged WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM categories)
        UNION ALL SELECT 'domain', count(*) FROM damaged WHERE domain_id NOT IN (SELECT id FROM domains)
        UNION ALL SELECT 'duplicate_of', count(*) FROM damaged WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT id FROM damaged)"""),
    "category_options": (["complaints", "domains", "categories"], """
        SELECT d.name AS domain, row_number() OVER (PARTITION BY d.id ORDER BY k.name, k.id) AS place, k.name AS category, k.id AS category_id, k.sla_hours, n AS n_complaints FROM (SELECT domain_id, count(*) AS n FROM complaints GROUP BY 1) u
        JOIN domains d ON d.id = u.domain_id JOIN categories k ON k.domain_id = u.domain_id"""),
    "legal_actions": (["complaints", "grants"], """
        SELECT id, status, submitted_by, coalesce(t, FALSE) AND status IN ('in_review','resolved') AS can_start_work, coalesce(a, FALSE) AND status NOT IN ('closed','duplicate') AS can_assign,
          coalesce(m, FALSE) AND status IN ('submitted','in_review','in_progress') AS can_mark_duplicate, coalesce(r, FALSE) AND status = 'in_progress' AS can_resolve, coalesce(r, FALSE) AND status = 'resolved' AS can_close
        FROM complaints LEFT JOIN (SELECT user_id, bool_or(permission = 'complaints.triage_complaint') AS t, bool_or(permission = 'complaints.assign_complaint') AS a,
          bool_or(permission = 'complaints.mark_duplicate') AS m, bool_or(permission = 'complaints.resolve_complaint') AS r FROM grants GROUP BY 1) ON user_id = submitted_by"""),
    "delete_effects": (["complaints", "domains", "categories", "history", "predictions"], """
        SELECT * FROM (
          SELECT 'deleted' AS effect, 'domain' AS entity, count(*) AS n FROM domains WHERE NOT is_active
          UNION ALL SELECT 'deleted', 'category', count(*) FROM categories WHERE domain_id IN (SELECT id FROM domains WHERE NOT is_active)
          UNION ALL SELECT 'deleted', 'user', count(*) FROM customer WHERE c_acctbal < 0
          UNION ALL SELECT 'deleted', 'complaint', count(*) FROM complaints WHERE status = 'closed'
          UNION ALL SELECT 'deleted', 'event', count(*) FROM history WHERE complaint_id IN (SELECT id FROM complaints WHERE status = 'closed')
          UNION ALL SELECT 'deleted', 'prediction', count(*) FROM predictions WHERE complaint_id IN (SELECT id FROM complaints WHERE status = 'closed')
          UNION ALL SELECT 'refused', 'complaint.domain_id', count(*) FROM complaints WHERE status <> 'closed' AND domain_id IN (SELECT id FROM domains WHERE NOT is_active)
          UNION ALL SELECT 'refused', 'complaint.category_id', count(*) FROM complaints WHERE status <> 'closed' AND category_id IN (SELECT c.id FROM categories c JOIN domains d ON d.id = c.domain_id WHERE NOT is_active)
          UNION ALL SELECT 'refused', 'complaint.submitted_by', count(*) FROM complaints WHERE status <> 'closed' AND submitted_by IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
          UNION ALL SELECT 'nulled', 'complaint.assignee_id', count(*) FROM complaints WHERE status <> 'closed' AND assignee_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
          UNION ALL SELECT 'nulled', 'complaint.duplicate_of', count(*) FROM complaints WHERE status <> 'closed' AND duplicate_of IN (SELECT id FROM complaints WHERE status = 'closed')
          UNION ALL SELECT 'nulled', 'event.actor_id', count(*) FROM history WHERE complaint_id NOT IN (SELECT id FROM complaints WHERE status = 'closed') AND actor_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
          UNION ALL SELECT 'nulled', 'event.prediction_id', count(*) FROM history WHERE complaint_id NOT IN (SELECT id FROM complaints WHERE status = 'closed')
            AND prediction_id IN (SELECT id FROM predictions WHERE complaint_id IN (SELECT id FROM complaints WHERE status = 'closed'))) WHERE n > 0"""),
    "event_order": (["history"], "SELECT id, complaint_id, row_number() OVER (PARTITION BY complaint_id ORDER BY created_at, id) AS pos FROM history"),
    "prediction_order": (["predictions"], "SELECT id, complaint_id, kind, row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos FROM predictions"),
    "domain_order": (["domains"], "SELECT id, slug, name, row_number() OVER (ORDER BY name, id) AS pos FROM domains"),
    "viewer_actions": (["complaints", "users", "grants"], """
        SELECT u.id AS user_id, count(c.id) AS n_visible, count(*) FILTER (WHERE t AND status IN ('in_review','resolved')) AS n_can_start_work, count(*) FILTER (WHERE a AND status NOT IN ('closed','duplicate')) AS n_can_assign,
          count(*) FILTER (WHERE m AND status IN ('submitted','in_review','in_progress')) AS n_can_mark_duplicate, count(*) FILTER (WHERE r AND status = 'in_progress') AS n_can_resolve, count(*) FILTER (WHERE r AND status = 'resolved') AS n_can_close
        FROM users u LEFT JOIN (SELECT user_id, bool_or(permission = 'complaints.triage_complaint') AS t, bool_or(permission = 'complaints.assign_complaint') AS a, bool_or(permission = 'complaints.mark_duplicate') AS m,
            bool_or(permission = 'complaints.resolve_complaint') AS r, bool_or(permission = 'complaints.view_queue') AS v FROM grants GROUP BY 1) g ON g.user_id = u.id
          LEFT JOIN complaints c ON coalesce(v, FALSE) OR c.submitted_by = u.id GROUP BY 1"""),
    "queue_display": (["complaints", "domains", "categories", "users"], f"""
        SELECT c.id, d.name AS domain, coalesce(k.name, 'Untriaged') AS category,
          CASE c.priority WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' WHEN 'critical' THEN 'Critical' ELSE 'Not set' END AS priority,
          CASE status WHEN 'submitted' THEN 'Submitted' WHEN 'in_review' THEN 'In review' WHEN 'in_progress' THEN 'In progress' WHEN 'resolved' THEN 'Resolved' END AS status,
          coalesce(u.username, 'Unassigned') AS assignee, due_at, CASE WHEN due_at < {AS_OF} AND resolved_at IS NULL THEN 'Overdue' ELSE '' END AS badge
        FROM complaints c JOIN domains d ON d.id = c.domain_id LEFT JOIN categories k ON k.id = c.category_id LEFT JOIN users u ON u.id = c.assignee_id WHERE status NOT IN ('closed','duplicate')"""),
    "intake_defaults": (["validated"], """
        SELECT id, domain_id, NULL::BIGINT AS category_id, NULL::VARCHAR AS priority, 'submitted' AS status, title, body, submitted_by, NULL::BIGINT AS assignee_id, NULL::BIGINT AS duplicate_of,
          TIMESTAMP '2001-08-03' AS created_at, NULL::TIMESTAMP AS triaged_at, NULL::TIMESTAMP AS due_at, NULL::TIMESTAMP AS resolved_at FROM validated WHERE reason IS NULL"""),
    "complaint_history": (["history", "users", "predictions"], """
        SELECT h.id AS event_id, h.complaint_id, h.kind, CASE h.kind WHEN 'status' THEN 'Status change' WHEN 'category' THEN 'Category change' WHEN 'priority' THEN 'Priority change' ELSE 'Duplicate decision' END AS kind_label,
          from_value, to_value, username AS actor, p.kind AS prediction_kind, model_version, note, h.created_at FROM history h LEFT JOIN users u ON u.id = actor_id LEFT JOIN predictions p ON p.id = h.prediction_id"""),
    "command_access": (["access"], "SELECT seq, complaint_id, op, actor_id, denied FROM access"),
    "authorised_state": (["permitted_ended"], "SELECT * FROM permitted_ended"),
    "authorised_refusals": (["permitted_marked", "permitted_walk", "access"], """
        SELECT complaint_id, seq, ts, op, status_before, reason FROM permitted_marked WHERE reason IS NOT NULL
        UNION ALL SELECT complaint_id, seq, ts, 'mark_duplicate', status_before, reason FROM permitted_walk WHERE reason IS NOT NULL
        UNION ALL SELECT complaint_id, seq, ts, op, NULL, denied FROM access WHERE denied IS NOT NULL"""),
    "assignable_users": (["users", "grants"], "SELECT id, username, row_number() OVER (ORDER BY username, id) AS pos FROM users WHERE id IN (SELECT user_id FROM grants WHERE permission = 'complaints.view_queue')"),
    "user_permissions": (["grants"], "SELECT user_id, permission FROM grants"),
    "permission_matrix": (["users", "grants", "all_permissions"], """
        SELECT id AS user_id, permission, (id, permission) IN (SELECT (user_id, permission) FROM grants) AS granted FROM users, all_permissions"""),
    "visible_counts": (["complaints", "users", "grants"], """
        SELECT u.id AS user_id, a.user_id IS NOT NULL AS sees_all, CASE WHEN a.user_id IS NOT NULL THEN (SELECT count(*) FROM complaints) ELSE coalesce(n, 0) END AS n_visible
        FROM users u LEFT JOIN (SELECT user_id FROM grants WHERE permission = 'complaints.view_queue') a ON a.user_id = u.id
        LEFT JOIN (SELECT submitted_by, count(*) AS n FROM complaints GROUP BY 1) o ON o.submitted_by = u.id"""),
    "duplicate_pairs": (["complaints"], """
        SELECT a.id, a.duplicate_of, a.domain_id, b.domain_id AS canonical_domain, b.status AS canonical_status FROM complaints a LEFT JOIN complaints b ON b.id = a.duplicate_of WHERE a.duplicate_of IS NOT NULL"""),
    "acceptance_verdict": (["judged"], "SELECT id, complaint_id, kind, to_value, prediction_kind, accepted FROM judged WHERE kind IN ('category','duplicate')"),
    "latest_prediction": (["latest"], "SELECT complaint_id, kind, id, model_version, created_at FROM latest"),
    "model_registry": (["domains", "predictions"], """
        SELECT slug AS domain_slug, w.kind, w.version AS model_version, coalesce(n, 0)::BIGINT AS n_predictions FROM (
          SELECT id, slug, kind, CASE WHEN kind = 'risk' THEN 'v1' WHEN slug = 'asia' AND kind = 'triage' THEN 'v2' WHEN slug = 'europe' AND kind = 'triage' THEN 'v1' ELSE 'null' END AS version
          FROM domains, (VALUES ('triage'),('dedup'),('risk')) k(kind))
        w LEFT JOIN (SELECT domain_id, kind, model_version AS version, count(*) AS n FROM predictions GROUP BY ALL) p ON p.domain_id = w.id AND p.kind = w.kind AND p.version = w.version"""),
    "category_history_asof": (["past"], """
        SELECT id, category_id, n_resolved, CASE WHEN n_resolved > 0 THEN round(s / n_resolved / 3600, 6) END AS mean_resolution_hours, CASE WHEN n_resolved > 0 THEN round(b / n_resolved, 6) END AS breach_rate FROM past WHERE probe"""),
    "default_role": (["user_groups"], "SELECT user_id, group_name FROM user_groups"),
    "acceptance_rate": (["judged"], """
        SELECT domain_id, prediction_kind, model_version, count(*) AS n_decisions, count(*) FILTER (WHERE accepted) AS n_accepted, round(count(*) FILTER (WHERE accepted) / count(*), 6) AS acceptance_rate
        FROM judged WHERE accepted IS NOT NULL GROUP BY ALL"""),
    "override_corpus": (["judged", "titled"], """
        SELECT complaint_id, kind, to_value AS human_label, model_version, title, body FROM judged JOIN titled t ON t.id = complaint_id WHERE NOT accepted"""),
    "category_history": (["complaints"], """
        SELECT domain_id, category_slug, count(*) AS n_resolved, round(sum(epoch(resolved_at - triaged_at)) / count(*) / 3600, 6) AS mean_resolution_hours, round(count(*) FILTER (WHERE resolved_at > due_at) / count(*), 6) AS breach_rate
        FROM complaints WHERE resolved_at IS NOT NULL AND category_id IS NOT NULL GROUP BY ALL"""),
    "queue_depth": (["complaints", "depths"], "SELECT id, depth::BIGINT AS queue_depth FROM complaints c JOIN depths d ON d.domain_id = c.domain_id AND d.moment = c.created_at"),
    "assignee_load": (["complaints"], "SELECT assignee_id, count(*) AS open_count FROM complaints WHERE assignee_id IS NOT NULL AND status NOT IN ('closed','duplicate') GROUP BY 1"),
    "sla_breach_report": (["complaints"], """
        SELECT domain_id, category_slug, priority, count(*) AS n_resolved, count(*) FILTER (WHERE resolved_at > due_at) AS n_breached, round(count(*) FILTER (WHERE resolved_at > due_at) / count(*), 6) AS breach_rate
        FROM complaints WHERE resolved_at IS NOT NULL AND due_at IS NOT NULL GROUP BY ALL"""),
    "page_counts": (["complaints", "users"], """
        SELECT u.id AS user_id, coalesce(n, 0) AS n_complaints, greatest(1, ceil(coalesce(n, 0) / 25))::BIGINT AS num_pages FROM users u LEFT JOIN (SELECT submitted_by, count(*) AS n FROM complaints GROUP BY 1) o ON o.submitted_by = u.id"""),
    "event_kinds": (["history"], "SELECT complaint_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM history GROUP BY 1"),
    "confusion_matrix": (["confusion"], "SELECT label, predicted, n FROM confusion"),
    "class_metrics": (["scored_classes"], """
        SELECT class, true_positives, n_predicted, n_labelled, round(precision_raw, 6) AS precision, round(recall_raw, 6) AS recall, round(f1_raw, 6) AS f1 FROM scored_classes"""),
    "macro_f1": (["scored_classes"], "SELECT round(avg(f1_raw), 6) AS macro_f1 FROM scored_classes"),
    "top3_accuracy": (["shortlists"], "SELECT count(*) AS n, round(avg(((place - shift + 5) % 5 < 3)::INTEGER), 6) AS top3_accuracy FROM shortlists"),
    "baselines": (["graded"], """
        SELECT round(max(n) / sum(n), 6) AS majority_accuracy, arg_max(label, (n, label)) AS majority_label, round(sum((n / total) * (n / total)), 6) AS stratified_accuracy
        FROM (SELECT label, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS total FROM graded GROUP BY 1)"""),
    "roc_auc": (["auc"], "SELECT round(value, 6) AS roc_auc FROM auc"),
    "precision_at_k": (["ranked"], """
        SELECT k::BIGINT AS k, round(count(*) FILTER (WHERE label AND rn <= k) / least(k, count(*)), 6) AS precision_at_k FROM (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rn FROM ranked), (VALUES (10),(100),(1000)) v(k) GROUP BY k"""),
    "calibration_curve": (["ranked"], """
        SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label::INTEGER), 6) AS observed_rate FROM ranked GROUP BY 1"""),
    "metric_floor": (["auc", "scored_classes", "shortlists"], """
        SELECT metric, round(value, 6) AS value, floor, value < floor AS failed FROM (
          SELECT 'roc_auc' AS metric, value, 0.55::DOUBLE AS floor FROM auc UNION ALL SELECT 'macro_f1', avg(f1_raw), 0.5 FROM scored_classes
          UNION ALL SELECT 'top3_accuracy', avg(((place - shift + 5) % 5 < 3)::INTEGER), 0.5 FROM shortlists)"""),
    "queue_page": (["complaints"], """
        SELECT id, status, due_at, created_at FROM complaints WHERE status NOT IN ('closed','duplicate') ORDER BY due_at ASC NULLS FIRST, created_at DESC, id DESC LIMIT 25 OFFSET 50"""),
    "risk_queue": (["complaints", "latest"], """
        SELECT c.id, status, score, due_at, row_number() OVER (ORDER BY score DESC NULLS LAST, due_at ASC NULLS FIRST, c.id) AS pos FROM complaints c LEFT JOIN (SELECT complaint_id, score FROM latest WHERE kind = 'risk') ON complaint_id = c.id WHERE status NOT IN ('closed','duplicate')"""),
    "complaint_label": (["titled"], "SELECT id, '#' || id || ' ' || substr(title, 1, 60) AS label FROM titled"),
    "taxonomy_drift": (["damaged", "categories"], """
        SELECT category_id, 'undeclared' AS side FROM (SELECT DISTINCT category_id FROM damaged WHERE category_id IS NOT NULL EXCEPT SELECT id FROM categories)
        UNION ALL SELECT id, 'missing' FROM (SELECT id FROM categories EXCEPT SELECT category_id FROM damaged)"""),
    "priority_rank": (["base"], "SELECT id, priority, CASE priority WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 WHEN 'critical' THEN 1.0 END::DOUBLE AS priority_rank FROM base"),
    "sla_clock": (["complaints"], "SELECT id, triaged_at, sla_hours, due_at FROM complaints WHERE triaged_at IS NOT NULL"),
    "submitted_parts": (["base"], f"""
        SELECT id, hour(created_at) AS submitted_hour, isodow(created_at) - 1 AS submitted_weekday, round(epoch({AS_OF} - created_at) / 3600, 6) AS age_hours FROM base"""),
    "text_length": ([], "SELECT doc_id, length(text) AS text_length FROM documents"),
    "null_scores": (["complaints"], """
        SELECT id, NULL::VARCHAR AS category_slug, 0.0::DOUBLE AS confidence, 0::BIGINT AS n_matches, 0.0::DOUBLE AS score, 'unknown' AS band, 'null' AS model_version FROM complaints"""),
    "retriage_due": (["checked"], """
        SELECT seq, complaint_id, first_value(ts) OVER w AS triaged_at, first_value(ts) OVER w + to_hours(sla_hours) AS due_at FROM checked WHERE op = 'triage' AND refusal IS NULL WINDOW w AS (PARTITION BY complaint_id ORDER BY ts, seq)"""),
    "lifecycle_state": (["ended"], "SELECT * EXCLUDE (duplicate_of) FROM ended"),
    "lifecycle_refusals": (["marked", "walk"], """
        SELECT complaint_id, seq, ts, op, status_before, reason FROM marked WHERE reason IS NOT NULL
        UNION ALL SELECT complaint_id, seq, ts, 'mark_duplicate', status_before, reason FROM walk WHERE reason IS NOT NULL"""),
    "lifecycle_events": (["marked", "walk", "commands"], """
        SELECT complaint_id, seq, row_number() OVER (PARTITION BY seq ORDER BY o) - 1 AS ord, kind, from_value, to_value, actor_id, note, ts AS created_at FROM (
          SELECT complaint_id, seq, 0 AS o, 'category' AS kind, old_slug AS from_value, slug AS to_value, actor_id, '' AS note, ts FROM marked WHERE op = 'triage' AND reason IS NULL
          UNION ALL SELECT complaint_id, seq, 1, 'priority', old_priority, priority, actor_id, '', ts FROM marked WHERE op = 'triage' AND reason IS NULL
          UNION ALL SELECT complaint_id, seq, 2, 'status', 'submitted', 'in_review', actor_id, 'Triaged', ts FROM marked WHERE op = 'triage' AND reason IS NULL AND status_before = 'submitted'
          UNION ALL SELECT complaint_id, seq, 3, 'assignment', old_assignee, assignee, actor_id, '', ts FROM marked WHERE op = 'assign'
          UNION ALL SELECT complaint_id, seq, 4, 'status', status_before, status, actor_id, '', ts FROM marked WHERE op = 'transition' AND reason IS NULL
          UNION ALL SELECT w.complaint_id, w.seq, e.o, e.kind, e.old, e.new, m.actor_id, '', w.ts FROM walk w JOIN commands m USING (seq),
            LATERAL (VALUES (5, 'status', w.status_before, 'duplicate'), (6, 'duplicate', NULL, w.canonical_id::VARCHAR)) e(o, kind, old, new) WHERE w.reason IS NULL)"""),
    "lifecycle_duplicates": (["ended"], "SELECT * FROM ended"),
    "duplicate_refusals": (["walk"], "SELECT complaint_id, seq, ts, 'mark_duplicate' AS op, status_before, reason FROM walk WHERE reason IS NOT NULL"),
    "canonical_root": (["chains"], """
        SELECT id, CASE WHEN NOT moving THEN root END AS root, CASE WHEN NOT moving THEN hops END AS hops FROM (
          SELECT *, root IN (SELECT id FROM looped WHERE duplicate_of IS NOT NULL AND duplicate_of <> id) AS moving FROM chains QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1)"""),
    "transition_matrix": (["complaints"], """
        SELECT f.s AS from_status, t.s AS to_status, (f.s, t.s) IN (('submitted','in_review'),('submitted','duplicate'),('in_review','in_progress'),('in_review','duplicate'),('in_progress','resolved'),('in_progress','duplicate'),('resolved','closed'),('resolved','in_progress')) AS allowed,
          (SELECT count(*) FROM complaints WHERE status = f.s) AS n_complaints FROM (VALUES ('submitted'),('in_review'),('in_progress'),('resolved'),('closed'),('duplicate')) f(s), (VALUES ('submitted'),('in_review'),('in_progress'),('resolved'),('closed'),('duplicate')) t(s)"""),
    "history_replay_diff": (["damaged", "history"], """
        SELECT id, field, replayed, stored FROM (
          SELECT d.id, v.field, v.replayed, v.stored FROM damaged d LEFT JOIN (
            SELECT complaint_id, arg_max(to_value, (created_at, id)) FILTER (WHERE kind = 'status') AS s, arg_max(to_value, (created_at, id)) FILTER (WHERE kind = 'category') AS c,
              arg_max(to_value, (created_at, id)) FILTER (WHERE kind = 'priority') AS p, arg_max(to_value, (created_at, id)) FILTER (WHERE kind = 'duplicate') AS u FROM history GROUP BY 1) h ON h.complaint_id = d.id,
            LATERAL (VALUES ('status', coalesce(h.s, 'submitted'), d.status), ('category', h.c, d.category_slug), ('priority', h.p, d.priority), ('duplicate', h.u, d.duplicate_of::VARCHAR)) v(field, replayed, stored))
        WHERE replayed IS DISTINCT FROM stored"""),
    "integrity_report": (["damaged", "domains", "categories", "history", "predictions"], """
        SELECT 'duplicate_requires_canonical' AS rule, count(*) AS n_violations FROM damaged WHERE status = 'duplicate' AND duplicate_of IS NULL
        UNION ALL SELECT 'duplicate_of_is_not_self', count(*) FROM damaged WHERE duplicate_of = id
        UNION ALL SELECT 'complaint_status_known', count(*) FROM damaged WHERE status NOT IN ('submitted','in_review','in_progress','resolved','closed','duplicate')
        UNION ALL SELECT 'complaint_priority_known', count(*) FROM damaged WHERE priority NOT IN ('low','medium','high','critical')
        UNION ALL SELECT 'domain_slug_unique', count(*) FROM (SELECT slug FROM domains GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'category_slug_unique_per_domain', count(*) FROM (SELECT slug FROM categories GROUP BY domain_id, slug HAVING count(*) > 1)
        UNION ALL SELECT 'sla_hours_positive', count(*) FROM categories WHERE sla_hours <= 0
        UNION ALL SELECT 'canonical_is_not_duplicate', count(*) FROM damaged a JOIN damaged b ON b.id = a.duplicate_of WHERE b.status = 'duplicate' OR b.duplicate_of IS NOT NULL
        UNION ALL SELECT 'duplicate_inside_domain', count(*) FROM damaged a JOIN damaged b ON b.id = a.duplicate_of WHERE b.domain_id <> a.domain_id
        UNION ALL SELECT 'category_inside_domain', count(*) FROM damaged a JOIN categories k ON k.id = a.category_id WHERE k.domain_id <> a.domain_id
        UNION ALL SELECT 'due_at_follows_triage', count(*) FROM damaged a JOIN categories k ON k.id = a.category_id WHERE a.due_at IS DISTINCT FROM a.triaged_at + to_hours(k.sla_hours)
        UNION ALL SELECT 'status_has_history', count(*) FROM damaged WHERE status <> 'submitted' AND id NOT IN (SELECT complaint_id FROM history WHERE kind = 'status')
        UNION ALL SELECT 'event_kind_known', count(*) FROM history WHERE kind NOT IN ('status','category','priority','assignment','duplicate')
        UNION ALL SELECT 'prediction_kind_known', count(*) FROM predictions WHERE kind NOT IN ('triage','dedup','risk')"""),
    "triage_abstain": (["predictions"], """
        SELECT id, complaint_id, confidence, CASE WHEN confidence >= 0.5 THEN slug END AS category_slug FROM predictions WHERE kind = 'triage'"""),
    "risk_bands": (["predictions"], """
        SELECT complaint_id, score, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN 'medium' ELSE 'low' END AS band FROM predictions WHERE kind = 'risk'"""),
    "holdout_split": ([], """
        SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 >= 8 THEN 'held_out'
          WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 >= 6 THEN 'calibrate' ELSE 'train' END AS split FROM documents"""),
    "word_ngrams": (["words"], _DIGEST.format(source="words")),
    "char_ngrams": (["chars"], _DIGEST.format(source="chars")),
    "perturb": ([], """
        SELECT doc_id AS original_id, kind, md5(t) AS digest, length(t) AS n_chars FROM (
          SELECT doc_id, 'truncate' AS kind, array_to_string(w[1:greatest(1, floor(len(w) * 6 / 10)::BIGINT)], ' ') AS t FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
          UNION ALL SELECT doc_id, 'typos', array_to_string(list_transform(w, lambda x, i: CASE WHEN (doc_id * 31 + (i - 1) * 17) % 10 = 0 AND length(x) >= 3 THEN substr(x, 1, 1) || substr(x, 3, 1) || substr(x, 2, 1) || substr(x, 4) ELSE x END), ' ')
            FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))"""),
    "tfidf": (["text_weights"], """
        SELECT doc_id AS id, count(*) FILTER (WHERE weight > 0) AS n_weights, round(coalesce(max(weight) / nullif(sqrt(sum(weight * weight)), 0), 0), 6) AS max_weight
        FROM documents LEFT JOIN text_weights USING (doc_id) GROUP BY 1"""),
    "dedup_tfidf": (["first_texts", "asked", "sims"], """
        SELECT query_id, match_id, similarity, rank FROM (
          SELECT q.id AS query_id, m.id AS match_id, similarity, row_number() OVER (PARTITION BY q.id ORDER BY similarity DESC, m.id) AS rank
          FROM asked q JOIN sims ON a = q.first JOIN first_texts m ON m.first = b WHERE m.id <> q.id AND similarity >= 0.5) WHERE rank <= 5"""),
    "embedding_decode": ([], "SELECT vec_id AS id, len(embedding) AS n_dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings"),
    "dedup_topk": ([], """
        SELECT query_id, match_id, similarity, rank FROM (
          SELECT a.vec_id AS query_id, b.vec_id AS match_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
            row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5 AND similarity >= 0.3"""),
    "risk_features": (["complaints", "past", "depths", "loads"], """
        SELECT c.id, c.domain_id, sla_hours::BIGINT AS sla_hours, coalesce(CASE WHEN n_resolved > 0 THEN round(s / n_resolved / 3600, 6) END, 0.0) AS category_mean_resolution_hours,
          coalesce(CASE WHEN n_resolved > 0 THEN round(b / n_resolved, 6) END, 0.0) AS category_breach_rate,
          CASE priority WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 WHEN 'critical' THEN 1.0 END::DOUBLE AS priority_rank,
          round(epoch(triaged_at - created_at) / 3600, 6) AS age_hours, hour(created_at) AS submitted_hour, isodow(created_at) - 1 AS submitted_weekday, t.n_chars AS text_length,
          d.depth::BIGINT AS queue_depth, coalesce(l.n, 0)::BIGINT AS assignee_open_count, resolved_at > due_at AS breached
        FROM complaints c LEFT JOIN past p ON p.probe AND p.id = c.id LEFT JOIN depths d ON d.domain_id = c.domain_id AND d.moment = c.created_at
          LEFT JOIN loads l ON l.assignee_id = c.assignee_id AND l.moment = c.triaged_at LEFT JOIN documents t ON t.doc_id = c.id % (SELECT count(*) FROM documents)
        WHERE c.triaged_at IS NOT NULL AND c.category_id IS NOT NULL"""),
}


def _needed(names: list[str], found: list[str]) -> list[str]:
    for name in names:
        if name not in found:
            _needed(TABLES[name][0], found)
            found.append(name)
    return found


#: The lifecycle once more, over the permitted commands only; a mark may still point at any complaint.
_FOLD = ("commands", "checked", "numbered", "folded", "marks", "walk", "marked", "ended")
_fold_names = re.compile(rf"\b({'|'.join(_FOLD)})\b(?! AS known)")
for _name in _FOLD[1:]:
    _needs, _body = TABLES[_name]
    TABLES[f"permitted_{_name}"] = (
        [*(f"permitted_{n}" if n in _FOLD else n for n in _needs), *(["commands"] if _name == "marks" else [])],
        _fold_names.sub(r"permitted_\1", _body).replace("IN (SELECT complaint_id FROM permitted_commands) AS known", "IN (SELECT complaint_id FROM commands) AS known"),
    )


def statement(name: str) -> str:
    needs, body = QUERIES[name]
    ctes = ", ".join(f"{n} AS ({TABLES[n][1].strip()})" for n in _needed(needs, []))
    return f"WITH RECURSIVE {ctes} {body.strip()}" if ctes else body.strip()
