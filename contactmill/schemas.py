"""Table schemas: the unified lead, the CRM row and the saved JSON documents."""

PROFILE = "username string, full_name string, bio string, location string, job_title string, employee_count string"
HANDLES = ("instagram string, twitter string, facebook string, linkedin string, youtube string, tiktok string, "
           "other array<string>")
CONTENT = "caption string, upload_date string, channel_name string, author_name string"
EXTRAS = ["industry", "revenue", "lead_category", "lead_sub_category", "company_name", "company_type",
          "decision_makers", "bdr", "product_interests", "timeline", "interest_level"]


def _struct(fields: str) -> str:
    depth, parts, cur = 0, [], ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return "struct<" + ", ".join(p.strip().replace(" ", ":", 1) for p in parts + [cur]) + ">"


CONTACT = ("emails array<string>, phone_numbers array<string>, address string, websites array<string>, "
           f"social_media_handles {_struct(HANDLES)}, bio_links array<string>")
UNIFIED = (f"url string, platform string, content_type string, source string, icp_identifier string, "
           f"profile {_struct(PROFILE)}, contact {_struct(CONTACT)}, content {_struct(CONTENT)}, "
           "scraped_at timestamp, data_quality_score double, " + ", ".join(f"{c} string" for c in EXTRAS))

AI_CONTACT = ("struct<name:string, email:string, phone:string, organization:string, role:string, confidence:double, "
              "source:string, notes:string, lead_category:string, lead_sub_category:string>")
ORGANIZATION = ("struct<primary_name:string, industry:string, services:array<string>, location:string, "
                "organization_type:string>")
AI_ADDRESS = "struct<address:string, type:string, confidence:double, source:string, notes:string>"
AI_LEAD = f"struct<ai_contacts:array<{AI_CONTACT}>, organization_info:{ORGANIZATION}, addresses:array<{AI_ADDRESS}>>"
MODEL_OUTPUT = (f"contacts array<{AI_CONTACT}>, organization_info {ORGANIZATION}, addresses array<{AI_ADDRESS}>, "
                "overall_confidence double, summary string")
WEB_RAW = (f"id string, source_url string, contact_person string, business_name string, email array<string>, "
           f"phone array<string>, location string, social_media map<string,string>, industry string, company_type string, "
           f"services array<string>, lead_score double, extraction_timestamp string, ai_leads array<{AI_LEAD}>")
LEAD = ("id string, source_url string, extraction_timestamp string, business_name string, contact_person array<string>, "
        "email array<string>, phone array<string>, address array<string>, website array<string>, "
        "social_media map<string,struct<platform:string, url:string>>, industry string, services array<string>, "
        "lead_score double, lead_classification string, confidence_scores map<string,double>, data_sources array<string>, "
        f"quality_score double, status string, ai_leads array<{AI_LEAD}>")
ICP = ("product_details struct<product_name:string, product_category:string, usps:array<string>, "
       "pain_points_solved:array<string>>, icp_information struct<target_industry:array<string>, "
       "competitor_companies:array<string>, company_size:string, decision_maker_persona:array<string>, "
       "region:array<string>, budget_range:string, occasions:array<string>>")
