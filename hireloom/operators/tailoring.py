"""Edit proposals and letters per (resume, posting)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.skills import title_skill
from hireloom.functions.text import blank_to_null, clean_list, first_items, skill_key, str_array, strip, tokens

LETTER_MODEL = "cover-letter-heuristic-v1"

# Sentences of the proposals and of the letter.
NO_SUMMARY = "Experienced professional delivering measurable outcomes."
HEADLINE_TITLE = "Align headline with the target role"
SUMMARY_TITLE = "Sharpen summary for this posting"
SUMMARY_WHY = "Lead with the target role and weave in skills the job emphasizes."
SKILLS_TITLE = "Add missing skills from the job"
BULLET_TITLE = "Add a role-aligned bullet to latest experience"
BULLET_WHY = (
    "Surface keywords from the posting in your most recent role so ATS and humans both see the fit."
)
NO_OP_TITLE = "Resume already aligns well"
NO_OP_WHY = "No high-confidence structural tweaks were found for this posting."
NO_SKILLS = "My experience aligns closely with the requirements described in this posting."
NO_IMPACT = (
    "I have delivered measurable outcomes across data platforms, reliability, and stakeholder "
    "collaboration."
)
CLOSING = (
    "I would welcome the opportunity to discuss how I can contribute to your team. "
    "Thank you for your time and consideration."
)


def _keys(skills: Column) -> Column:
    return F.filter(F.transform(skills, skill_key), lambda k: k != "")


def target_skills(wanted: Column, title: Column, description: Column, limit: int | None = None) -> Column:
    """Required skills, else the tokens of title and description."""
    listed = _keys(F.coalesce(wanted, str_array([])))
    words = tokens(F.concat_ws("\n", title, F.coalesce(description, F.lit(""))))
    fallback = first_items(F.array_sort(F.filter(words, lambda t: F.length(t) >= 3)), limit)
    return F.when(F.size(listed) > 0, listed).otherwise(fallback)


def _with_gap(pairs: DataFrame) -> DataFrame:
    """Add resume skill list, matched and missing target skills."""
    have = clean_list(F.col("content.skills"))
    target = target_skills(F.col("wanted"), F.col("title"), F.col("description"))
    return (
        pairs.withColumn("_have", have)
        .withColumn("_target", F.array_distinct(target))
        .withColumn("_keys", F.array_distinct(_keys(F.col("_have"))))
        .withColumn("matched_skills", F.array_sort(F.array_intersect("_target", "_keys")))
        .withColumn("missing_skills", F.array_sort(F.array_except("_target", "_keys")))
    )


def _shown(skills: Column, limit: int | None) -> Column:
    return F.array_join(F.transform(first_items(skills, limit), title_skill), ", ")


def _suggestion(
    when: Column, name: str, section: str, title: str, why: Column, path: str,
    before: Column | None = None, after: Column | None = None,
    before_list: Column | None = None, after_list: Column | None = None, selected: bool = True,
) -> Column:
    text = F.lit(None).cast("string")
    items = F.lit(None).cast("array<string>")
    return F.when(
        when,
        F.struct(
            F.lit(name).alias("id"),
            F.lit(section).alias("section"),
            F.lit(title).alias("title"),
            why.alias("rationale"),
            F.lit(path).alias("path"),
            (text if before is None else before).alias("before"),
            (text if after is None else after).alias("after"),
            (items if before_list is None else before_list).alias("before_list"),
            (items if after_list is None else after_list).alias("after_list"),
            F.lit(selected).alias("selected_by_default"),
        ),
    )


def suggest(pairs: DataFrame, shown_skills: int | None = None, title_words: int | None = None) -> DataFrame:
    """Add ``suggestions`` to rows of content, title, description, wanted, company_name.

    ``shown_skills`` and ``title_words`` shorten the sentences only.
    """
    rows = _with_gap(pairs)
    title, missing = F.col("title"), F.col("missing_skills")
    company = blank_to_null(F.col("company_name"))
    stop = str_array(vocab.TITLE_STOP)
    bits = F.filter(
        F.regexp_extract_all(title, F.lit(r"[A-Za-z][A-Za-z+#.]{1,}"), F.lit(0)),
        lambda w: ~F.array_contains(stop, F.lower(w)),
    )
    focus = F.coalesce(blank_to_null(F.array_join(first_items(bits, title_words), " ")), title)
    now_headline = F.coalesce("content.headline", F.lit(""))
    new_headline = F.regexp_replace(
        F.concat(focus, F.coalesce(F.concat(F.lit(" | "), company), F.lit(""))),
        r"^[ |]+|[ |]+$", "",
    )
    now_summary = strip(F.coalesce("content.summary", F.lit("")))
    phrase = F.when(F.size(missing) > 0, _shown(missing, shown_skills)).otherwise(
        _shown(F.col("matched_skills"), shown_skills)
    )
    new_summary = F.concat(
        F.lit("Targeting "), title, F.lit(" at "), F.coalesce(company, F.lit("this company")),
        F.lit(". "), F.coalesce(blank_to_null(now_summary), F.lit(NO_SUMMARY)),
        F.lit(" Emphasizing "), F.coalesce(blank_to_null(phrase), F.lit("relevant domain skills")),
        F.lit(" aligned to this posting."),
    )
    role = F.get(F.col("content.experience"), F.lit(0))
    bullets = F.filter(F.coalesce(role["bullets"], str_array([])), lambda x: x.isNotNull())
    bullet = F.concat(
        F.lit("Applied "), _shown(missing, shown_skills), F.lit(" to deliver outcomes relevant to "), title,
        F.lit("."),
    )
    alike = F.exists(
        bullets, lambda x: skill_key(x).contains(skill_key(F.col("_bullet")))
    )
    some_missing = F.size(missing) > 0
    rows = rows.withColumn("_bullet", bullet)
    found = F.array_compact(
        F.array(
            _suggestion(
                F.lower(strip(now_headline)) != F.lower(new_headline),
                "headline", "headline", HEADLINE_TITLE,
                F.concat(
                    F.lit("Mirror the job title language so recruiters scanning for “"), focus,
                    F.lit("” see an immediate match."),
                ),
                "headline", blank_to_null(now_headline), new_headline,
            ),
            _suggestion(
                new_summary != now_summary, "summary", "summary", SUMMARY_TITLE,
                F.lit(SUMMARY_WHY), "summary", blank_to_null(F.col("content.summary")),
                new_summary,
            ),
            _suggestion(
                some_missing, "skills", "skills", SKILLS_TITLE,
                F.concat(
                    F.lit("These appear in the job requirements but not on your resume: "),
                    F.array_join(first_items(missing, shown_skills), ", "), F.lit("."),
                ),
                "skills",
                before_list=F.col("_have"),
                after_list=F.concat("_have", F.transform(missing, title_skill)),
            ),
            _suggestion(
                some_missing & role.isNotNull() & ~alike,
                "experience_0_bullets", "experience", BULLET_TITLE, F.lit(BULLET_WHY),
                "experience.0.bullets",
                before_list=bullets,
                after_list=F.array_append(bullets, F.col("_bullet")),
            ),
        )
    )
    none = F.array(
        _suggestion(
            F.lit(True), "no_op", "general", NO_OP_TITLE, F.lit(NO_OP_WHY), "", selected=False
        )
    )
    return rows.withColumn(
        "suggestions", F.when(F.size(found) > 0, found).otherwise(none)
    ).drop("_have", "_target", "_keys", "_bullet")


def apply_suggestions(suggested: DataFrame, selected: Column | None = None) -> DataFrame:
    """Add ``proposed``: the content with the selected suggestions put in.

    Without a selection the defaults apply. Only the four known paths are set.
    """
    content = F.col("content")
    chosen = F.filter(
        "suggestions",
        lambda s: s["selected_by_default"]
        if selected is None
        else F.array_contains(selected, s["id"]),
    )
    rows = suggested.withColumn("_chosen", chosen)

    def pick(name: str) -> Column:
        return F.get(F.filter("_chosen", lambda s: s["id"] == name), F.lit(0))

    roles = content["experience"]
    bullets = pick("experience_0_bullets")["after_list"]
    proposed = (
        content.withField("headline", F.coalesce(pick("headline")["after"], content["headline"]))
        .withField("summary", F.coalesce(pick("summary")["after"], content["summary"]))
        .withField("skills", F.coalesce(pick("skills")["after_list"], content["skills"]))
        .withField(
            "experience",
            F.transform(
                roles,
                lambda e, i: F.when(
                    (i == 0) & bullets.isNotNull(), e.withField("bullets", bullets)
                ).otherwise(e),
            ),
        )
    )
    return rows.withColumn("proposed", proposed).drop("_chosen")


def letters(pairs: DataFrame, shown_skills: int | None = None) -> DataFrame:
    """Add subject and text of a letter, as one projection per pair."""
    rows = _with_gap(pairs)
    contact = F.col("content.contact")
    who = strip(F.coalesce(blank_to_null(contact["name"]), F.lit("Candidate")))
    company = strip(F.coalesce(blank_to_null(F.col("company_name")), F.lit("your team")))
    title = F.coalesce(blank_to_null(strip(F.col("title"))), F.lit("this role"))
    latest = F.get(F.col("content.experience"), F.lit(0))
    headline = F.regexp_replace(strip(blank_to_null(F.col("content.headline"))), r"\.+$", "")
    recent = F.concat(
        F.lit("most recently as "), blank_to_null(latest["title"]),
        F.coalesce(F.concat(F.lit(" at "), blank_to_null(latest["company"])), F.lit("")),
    )
    about = blank_to_null(F.array_join(F.array_compact(F.array(headline, recent)), ", "))
    opener = F.concat(
        F.lit("I am writing to apply for the "), title, F.lit(" position at "), company,
        F.lit("."), F.coalesce(F.concat(F.lit(" I am a "), about, F.lit(".")), F.lit("")),
    )
    fallback = F.transform("_have", skill_key)
    listed = F.when(F.size("matched_skills") > 0, F.col("matched_skills")).otherwise(fallback)
    highlights = F.transform(first_items(listed, shown_skills), title_skill)
    skills = F.when(
        F.size("highlights") > 0,
        F.concat(
            F.lit("My background includes hands-on work with "), F.array_join("highlights", ", "),
            F.lit(", which aligns closely with the requirements for this role."),
        ),
    ).otherwise(NO_SKILLS)
    bullet = F.get(
        F.filter(
            F.transform(F.coalesce(latest["bullets"], str_array([])), strip), lambda x: x != ""
        ),
        F.lit(0),
    )
    lowered = F.when(
        bullet.rlike(r"^\p{Lu}"),
        F.concat(F.lower(F.substring(bullet, 1, 1)), F.substring(bullet, 2, 1 << 30)),
    ).otherwise(bullet)
    impact = F.coalesce(
        F.concat(F.lit("In my recent work, "), lowered, F.lit(".")),
        blank_to_null(strip(F.col("content.summary"))),
        F.lit(NO_IMPACT),
    )
    impact = F.when(impact.endswith("."), impact).otherwise(F.concat(impact, F.lit(".")))
    why = F.concat(
        F.lit("I am especially interested in "), company, F.lit(" because this "), title,
        F.lit(
            " role is a strong fit for my experience building and operating data systems at scale."
        ),
    )
    header = F.concat_ws(
        "\n", who, blank_to_null(contact["email"]), blank_to_null(contact["location"])
    )
    text = F.concat_ws(
        "\n\n", header, F.lit("Dear Hiring Manager,"), opener, skills, impact, why, F.lit(CLOSING),
        F.concat(F.lit("Sincerely,\n"), who),
    )
    return (
        rows.withColumn("highlights", highlights)
        .withColumn(
            "subject", F.concat(F.lit("Application for "), title, F.lit(" — "), who)
        )
        .withColumn("letter", F.concat(text, F.lit("\n")))
        .withColumn("model_version", F.lit(LETTER_MODEL))
        .drop("_have", "_target", "_keys")
    )
