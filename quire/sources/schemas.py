"""Explicit schemas of the relational tables and the file layouts."""

TABLES: dict[str, str] = {
    "users": "user_id bigint, email string, is_active boolean, created_at timestamp",
    "generation_runs": (
        "run_id bigint, user_id bigint, job_description_id bigint, structured_resume_id bigint, status string, model_name string, "
        "token_input int, token_output int, cost_estimate decimal(10,6), started_at timestamp, completed_at timestamp, delete_flg boolean"
    ),
    "documents": "doc_id bigint, run_id bigint, user_id bigint, company_name string, job_title string, created_at timestamp",
    "job_descriptions": "job_description_id bigint, user_id bigint, url string, raw_text string, source_type string, delete_flg boolean, created_at timestamp",
    "structured_resumes": "resume_id bigint, user_id bigint, original_filename string, resume_json string, delete_flg boolean, created_at timestamp",
    "candidate_profiles": "profile_id bigint, user_id bigint, profile_json string, onboarding_completed boolean, prompt_synched boolean, updated_at timestamp",
    "drafts": "draft_id bigint, user_id bigint, resume_id bigint, source_hash string, draft_json string, updated_at timestamp",
    "evaluation_runs": "evaluation_id bigint, run_id bigint, truthfulness decimal(5,4), role_fit decimal(5,4), clarity decimal(5,4), seniority decimal(5,4), integrated decimal(5,4)",
    "benchmark_runs": "run_id bigint, user_id bigint, status string, integrated_score decimal(5,2), created_at timestamp",
    "benchmark_run_positions": "position_id bigint, run_id bigint, company string, role_title string, integrated_score decimal(5,2)",
    "billing": "user_id bigint, plan_type string, monthly_limit_override int, extra_credits int, subscription_status string, current_period_end timestamp",
    "monthly_usage": "user_id bigint, year int, month int, used bigint",
    "checkout_purchases": "checkout_session_id string, user_id bigint, granted_credits int, event_id string, created_at timestamp",
    "admin_config": "id bigint, model string, mode string",
}
SCORES_CSV = (
    "company string, role_title string, truthfulness int, role_fit int, seniority_positioning int, clarity_impact int, "
    "mechanism_quality int, constraint_compliance int, cover_letter_effectiveness int, overall_readiness int, integrated_score double"
)
SCORE_COLUMNS = [c.split()[0] for c in SCORES_CSV.split(", ")]
REPORT_VERSION = "assess_report_v1"
