"""Schemas of the catalog's tables and of the feeds that fill them, as DDL: reading them needs no session."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "subject": "id bigint not null, bangumi_id int not null, name string not null, name_cn string, summary string, type int, eps int, volumes int, air_date date, air_weekday int, image string, "
    "score decimal(3,1), rank int, collection_total int, nsfw boolean not null, import_status int not null, last_imported_at timestamp_ntz, created_at timestamp_ntz not null, updated_at timestamp_ntz not null",
    "episode": "id bigint not null, subject_id bigint not null, bangumi_ep_id int, type int not null, sort decimal(5,1), name string, name_cn string, duration string, airdate date, description string, "
    "status string not null, created_at timestamp_ntz not null",
    "subject_tag": "id bigint not null, subject_id bigint not null, name string not null, count int not null",
    "subject_relation": "id bigint not null, subject_id bigint not null, related_subject_id bigint not null, relation string not null",
    "user": "id bigint not null, username string not null, email string, nickname string, avatar string, role string not null, email_verified boolean not null, created_at timestamp_ntz, updated_at timestamp_ntz",
    "user_collection": "id bigint not null, user_id bigint not null, subject_id bigint not null, type int not null, rate int not null, ep_status int not null, created_at timestamp_ntz not null, "
    "updated_at timestamp_ntz not null",
    "import_record": "id bigint not null, mode string not null, season_key string, started_at timestamp_ntz not null, completed_at timestamp_ntz, status string not null, subject_count int not null, "
    "error_message string, created_at timestamp_ntz not null",
    "operation_log": "id bigint not null, user_id bigint, username string, action string not null, module string not null, method string, path string, params string, ip string, user_agent string, "
    "status int not null, error_msg string, duration_ms bigint, created_at timestamp_ntz not null",
}

FEEDS: dict[str, str] = {
    "subject": "id int, name string, name_cn string, summary string, type int, eps int, total_episodes int, volumes int, date string, nsfw boolean, images struct<large:string>, "
    "rating struct<score:decimal(3,1),rank:int>, collection struct<collect:int>, tags array<struct<name:string,count:int>>",
    "episode": "id int, type int, sort decimal(5,1), name string, name_cn string, duration string, airdate string, desc string",
    "relation": "id int, type int, relation string",
    "browse": "data array<struct<id:int,date:string>>, total int",
    "search": "data array<struct<id:int,name:string,name_cn:string,date:string>>, total int",
    "calendar": "items array<struct<id:int>>",
}
