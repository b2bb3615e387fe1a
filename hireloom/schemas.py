"""Column types of the engine's tables, in one place."""

from __future__ import annotations

COMPENSATION = "struct<currency:string,min:double,max:double,salary:string>"
REQUIREMENTS = (
    "struct<skills:array<string>,job_type:string,category:string,match_score:int,source:string>"
)

# Every provider reader ends in exactly these columns.
OBSERVATION = {
    "provider": "string",
    "external_id": "string",
    "title": "string",
    "company_name": "string",
    "description": "string",
    "location": "string",
    "remote_type": "string",
    "canonical_url": "string",
    "source_url": "string",
    "posted_at": "timestamp",
    "compensation": COMPENSATION,
    "requirements": REQUIREMENTS,
    "company_website": "string",
    "company_industry": "string",
    "raw_payload": "string",
}

LISTING_ITEM = (
    "struct<id:string,url:string,title:string,company_name:string,description:string,"
    "tags:array<string>,candidate_required_location:string,publication_date:string,"
    "salary:string,job_type:string,category:string>"
)
LISTING = f"struct<jobs:array<{LISTING_ITEM}>>"

SEARCH_RESULT = (
    "id string, title string, company string, location string, url string, "
    "skills_required array<string>, salary string, found_at timestamp, match_score int"
)

CONTACT = "struct<name:string,email:string,phone:string,location:string,links:array<string>>"
EXPERIENCE = (
    "struct<id:string,company:string,title:string,location:string,start_date:string,"
    "end_date:string,is_current:boolean,summary:string,bullets:array<string>,"
    "source_fact_ids:array<string>>"
)
EDUCATION = (
    "struct<id:string,institution:string,degree:string,specialization:string,location:string,"
    "start_date:string,end_date:string,is_current:boolean,score:string,score_type:string,"
    "summary:string,details:array<string>,source_fact_ids:array<string>>"
)
PROJECT = (
    "struct<id:string,title:string,organization:string,url:string,location:string,"
    "start_date:string,end_date:string,is_current:boolean,summary:string,bullets:array<string>,"
    "technologies:array<string>,source_fact_ids:array<string>>"
)
CERTIFICATION = (
    "struct<id:string,title:string,issuer:string,date:string,expiry_date:string,"
    "credential_id:string,url:string,summary:string,source_fact_ids:array<string>>"
)
AWARD = (
    "struct<id:string,title:string,issuer:string,date:string,summary:string,"
    "source_fact_ids:array<string>>"
)
PERSONAL = "struct<job_title:string,work_authorization:string,notes:string>"

RESUME_CONTENT = (
    f"struct<schema_version:string,contact:{CONTACT},headline:string,summary:string,"
    f"experience:array<{EXPERIENCE}>,education:array<{EDUCATION}>,skills:array<string>,"
    f"projects:array<{PROJECT}>,certifications:array<{CERTIFICATION}>,awards:array<{AWARD}>,"
    f"languages:array<string>,hobbies:array<string>,personal:{PERSONAL},links:array<string>>"
)
