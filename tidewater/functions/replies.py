"""Reading of YAML: by the C parser where it can't differ from the plain one, which is some twelve times slower."""

from __future__ import annotations

import re

#: What the two parsers take differently: tabs between tokens, halves of letters, also escaped.
_PLAIN = re.compile(r"[\t\ud800-\udfff]|\\u[dD][89a-fA-F]")


def read_yaml(text: str):
    """As `yaml.safe_load`; YAMLError for what isn't YAML."""
    import yaml

    if yaml.__with_libyaml__ and not _PLAIN.search(text):
        try:
            return yaml.load(text, yaml.CSafeLoader)
        except yaml.YAMLError:
            pass  # the plain parser says whether it is none
    return yaml.safe_load(text)
