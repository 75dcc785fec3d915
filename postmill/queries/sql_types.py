"""Columns the SQL side would return as 32-bit integers; the Spark side returns 64-bit ones."""

LONG_COLUMNS = {
    "address_features": ["metro_count"],
    "assemble_features": ["benefits_count", "soft_skills_count", "tech_stack_size", "description_len_words"],
    "basic_profile": ["columns_total", "columns"],
    "boolean_counts": ["benefits_count", "soft_skills_count", "hard_stack_count", "skills_count"],
    "career_nodes": ["grade_rank"],
    "career_nodes_fuzzy": ["grade_rank"],
    "cohort_analytics": ["cohort_id"],
    "cohort_sizes": ["cohort_id"],
    "cohort_skill_heatmap": ["cohort_id"],
    "data_skill_counts": ["skills_count", "core_data_skills_count", "ml_stack_count", "tech_stack_size"],
    "ensure_feature_columns": ["tech_stack_size"],
    "experience_range": ["exp_min_years", "exp_max_years"],
    "export_cohort_report": ["cohort_id"],
    "fill_counters": ["metro_count"],
    "handle_missingness": ["metro_count"],
    "keyword_flags_by_label": ["toxic", "quality"],
    "language_signals": ["lang_other_count"],
    "match_explicit_skill": ["match_score"],
    "order_categories": ["position"],
    "parse_dates": ["vacancy_age_days"],
    "processed_metrics": ["market_view_rows"],
    "run_manifest": ["column_count"],
    "salary_features": ["l_linenumber"],
    "segment_quality": ["position"],
    "skill_hits": ["hits"],
    "stack_aggregates": ["core", "ml", "size"],
    "stage_profile": ["columns"],
}
