"""Prompt / target construction as string templates rendered by `concat`.

A template is plain text with {gloss}, {text}, {ds} (dataset name) and {DS}
(upper-cased dataset name) placeholders; rendering splits it once on the
driver and builds one `concat` of literals and columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: templates ----------------------------------------------------

SEQ2SEQ = {
    "g2t": "translate {ds} gloss to text: {gloss}",
    "t2g": "translate text to {ds} gloss: {text}",
}

CHAT_TRAIN = {
    "g2t": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
            "You are an expert translator converting sign language gloss notation to natural language text. "
            "Follow {DS} dataset conventions.\n\n"
            "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
            "Convert this sign language gloss to text: {gloss}<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n\n"
            "{text}<|eot_id|>"),
    "t2g": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
            "You are an expert translator converting natural language text to sign language gloss notation. "
            "Follow {DS} gloss notation rules.\n\n"
            "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
            "Convert this text to sign language gloss: {text}<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n\n"
            "{gloss}<|eot_id|>"),
}

CHAT_INFER = {
    "g2t": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
            "You are an expert translator converting {ds} sign language gloss to natural text.\n\n"
            "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
            "Convert this sign language gloss to text: {gloss}<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "t2g": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
            "You are an expert translator converting text to {ds} sign language gloss notation.\n\n"
            "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
            "Convert this text to sign language gloss: {text}<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n\n"),
}

NOTEBOOK = {
    "g2t_plain": "translate gloss to english: {gloss}",
    "g2t_asl": "translate american sign language gloss to english text: {gloss}",
    "g2t_signum": "translate Sign Language gloss to English: {gloss}",
    "g2t_english_gloss": "translate english gloss to english text: {gloss}",
    "t2g_asl": "translate english text to american sign language gloss: {text}",
    "t2g_flan": "Translate this English text into American Sign Language gloss notation: {text}",
    "t2g_signum": "convert to sign language gloss: {text}",
    "none": "{text}",
}

RULES_TRAIN_T2G = (
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
    "You are an expert translator who converts natural English text to English gloss notation. Follow these critical rules:\n"
    "NUMERICAL ACCURACY:\n"
    "- Preserve ALL numbers exactly as they appear in the text\n"
    "- Maintain original numerical formatting (percentages, decimals, years)\n"
    "- Never change, approximate, or substitute numerical values\n"
    "GLOSS NOTATION RULES:\n"
    "- Use X-WE for \"we\", X-I for \"I\", X-YOU for \"you\", X-HE for \"he\", X-SHE for \"she\"\n"
    "- Use X-POSS for possessive \"'s\"\n"
    "- Use DESC-[word] for adjectives/adverbs (e.g., \"important\" → \"DESC-IMPORTANT\")\n"
    "- Remove articles (a, an, the) unless semantically crucial\n"
    "- Convert verbs to base form unless tense is critical\n"
    "- Use hyphens to connect multi-word concepts\n"
    "FORMATTING REQUIREMENTS:\n"
    "- Use ALL CAPS for gloss words\n"
    "- Preserve percentage format exactly (e.g., \"10%\" → \"10%\")\n"
    "- Maintain word order that captures English structure\n"
    "- Remove auxiliary verbs unless they carry meaning\n"
    "LINGUISTIC PRECISION:\n"
    "- Focus on semantic content over grammatical markers\n"
    "- Preserve proper nouns and technical terms\n"
    "- Maintain plural markers when semantically important\n"
    "Convert this English text into gloss notation:\n\n"
    "Text: {text}\n"
    "Reference: {gloss}"
)

RULES_INFER_T2G = (
    "You are an expert translator from English text to gloss notation. \n"
    "CRITICAL REQUIREMENTS:\n"
    "1. PRESERVE ALL NUMBERS EXACTLY - never change any numerical values\n"
    "2. Use ALL CAPS for gloss words\n"
    "3. Convert pronouns: we→X-WE, I→X-I, you→X-YOU, he→X-HE, she→X-SHE\n"
    "4. Convert possessives: 's→X-POSS\n"
    "5. Convert adjectives/adverbs: use DESC- prefix (e.g., important→DESC-IMPORTANT)\n"
    "6. Remove articles (a, an, the) unless semantically crucial\n"
    "7. Use base verb forms unless tense is critical\n"
    "8. Connect multi-word concepts with hyphens\n"
    "9. Remove auxiliary verbs unless they carry meaning\n"
    "10. Maintain word order that captures English structure\n"
    "Translate the following text into gloss notation. Output ONLY the gloss:\n\n"
    "Text: {text}\n"
    "Gloss:"
)

FLAN_T2G_VARIANTS = [
    "Translate this English text into American Sign Language gloss notation: {text}",
    "Convert the following English sentence to ASL gloss: {text}",
    "How would you express this in American Sign Language gloss notation? {text}",
]

_PH = re.compile(r"\{(gloss|text|ds|DS)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """[('lit', s) | ('col', name)] pieces of a template."""
    out, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("col", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def render(template: str, gloss=None, text=None, dataset: str = "") -> Column:
    """One `concat` of literals and the gloss/text columns."""
    cols = {"gloss": gloss, "text": text, "ds": F.lit(dataset), "DS": F.lit(dataset.upper())}
    pieces = [F.lit(v) if k == "lit" else (F.col(cols[v]) if isinstance(cols[v], str) else cols[v])
              for k, v in template_parts(template)]
    return F.concat(*pieces) if pieces else F.lit("")


def is_chat_model(model_name: str) -> bool:
    return "llama" in model_name.lower()


def training_prompt(task: str, dataset: str, model_name: str, gloss="gloss", text="translation") -> Column:
    """Template family chosen by the model name."""
    tpl = CHAT_TRAIN[task] if is_chat_model(model_name) else SEQ2SEQ[task]
    return render(tpl, gloss, text, dataset)


def inference_prompt(task: str, dataset: str, model_name: str, source="source") -> Column:
    """P3 (chat) / P1 (seq2seq) for generation: no target embedded."""
    if is_chat_model(model_name):
        tpl = CHAT_INFER[task]
    else:
        tpl = SEQ2SEQ[task]
    return render(tpl, source, source, dataset)


def target(task: str, gloss="gloss", text="translation") -> Column:
    """P5: translation for g2t, gloss otherwise."""
    return F.col(text) if task == "g2t" else F.col(gloss)
