"""Table schemas applied at read, so no job infers one."""

from __future__ import annotations

PERSON = (
    "struct<id:string, name:string, first_name:string, middle_name:string, last_name:string, nickname:string, "
    "email:string, phone:string, addr1:string, addr2:string, city:string, state:string, zip:string, dob:string, "
    "role:string, linked_client_id:string, linked_client_label:string, other_id:string, other_label:string>"
)
LOG = "struct<ts:string, user:string, text:string, done:boolean, edited:boolean, log_type:string>"
WORK_ITEM = (
    "struct<id:string, client_id:string, client_name:string, task_name:string, status:string, note:string, "
    "created_at:string, started_at:string, held_at:string, completed_at:string, updated_at:string>"
)
ACTIVE = "struct<work_item_id:string, task_name:string, task_kind:string, status:string, started_at:string, created_at:string>"
FILE_REQUEST = (
    "struct<id:string, tax_year:string, category:string, name:string, status:string, requested_date:string, "
    "received_date:string, due_date:string, repeat_next_year:boolean, source:string, priority:string, note:string, "
    "created_ts:string, updated_ts:string, archived:boolean>"
)
REMINDER = (
    "struct<id:string, title:string, category:string, status:string, priority:string, applies_every_year:boolean, "
    "tax_year:string, note:string, created_ts:string, updated_ts:string, archived:boolean>"
)
ISSUE = (
    "struct<id:string, type:string, category:string, tax_year:string, title:string, status:string, priority:string, "
    "opened_date:string, closed_date:string, note:string, related_file_request_id:string, created_ts:string, "
    "updated_ts:string, archived:boolean>"
)
DOCUMENT = (
    "struct<name:string, type:string, cluster:string, category:string, subcluster:string, tags:array<string>, "
    "ts:string, year:int, quarter:string, month:int, path:string>"
)
CLIENT_TEXT = (
    "name", "dba", "ein", "ssn", "file_location", "memo", "addr1", "addr2", "city", "state", "zip", "acct_mgr",
    "edd_number", "sales_tax_account", "entity_type", "ui_rate", "sales_tax_rate", "other_tax_rates", "tax_rates_last_checked",
)
CLIENT_LISTS = {
    "relations": PERSON,
    "officers": PERSON,
    "employees": PERSON,
    "logs": LOG,
    "work_items": WORK_ITEM,
    "file_requests": FILE_REQUEST,
    "annual_reminders": REMINDER,
    "client_issues": ISSUE,
    "documents": DOCUMENT,
}
CLIENTS = ", ".join(
    ["id string", "owner string", "is_individual boolean", f"active_work {ACTIVE}"]
    + [f"{c} string" for c in CLIENT_TEXT]
    + [f"{c} array<{t}>" for c, t in CLIENT_LISTS.items()]
)
RECURRENCE = "struct<freq:string, dom:int, dom2:int, weekday:int, anchor_date:string, months:array<int>>"
TASKS = (
    "id string, kind string, kind_other string, title string, client_idx bigint, client_name string, client_id string, "
    "company_idx bigint, company_name string, company_id string, ein string, "
    f"recurrence {RECURRENCE}, start_on string, effective_from string, end_on string, is_paused boolean, pause_from string, "
    "resume_from string, action_lead_days int, method string, completed array<string>, cancelled array<string>, "
    "is_enabled boolean, due string"
)
