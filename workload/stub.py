"""Offline stand-in for a model: the answers of `rules.RAW_RESPONSE`, by the source that the title in the
request names, so that engine time is measured apart from model time."""

from __future__ import annotations

import re

UNTITLED_SOURCE = "src2"

# The cases of `rules.RAW_RESPONSE`.
ANSWERS = {
    "src0": "Science -> Physics -> Optics",
    "src1": "  Commerce -> Finance \n",
    "src2": "```json\nCommerce -> Retail\n```",
    "src3": "```\nScience -> Biology\n```",
    "src9": '"Legal"',
    "src10": "分类结果：Commerce -> Retail -> Online",
    "src11": "Services\nsince the text is about services",
    "src12": "Review",
    "src13": "Science -> Physics -> Nope",
    "src14": "Nope -> Online",
    "src15": "science",
    "src16": "",
}
FAILED_SOURCE = "src17"
OTHER_ANSWER = "Science -> Physics -> Optics -> Lens"


def stub_provider():
    title = re.compile(r"^标题: \w+/(\w+)/\d+$", re.MULTILINE)

    def answer(obj_key: str, request: str) -> str:
        found = title.search(request)
        source = found[1] if found else UNTITLED_SOURCE
        if source == FAILED_SOURCE:
            raise RuntimeError("no answer")
        return ANSWERS.get(source, OTHER_ANSWER)

    return answer
