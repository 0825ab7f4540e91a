"""Small source trees of our own, with the counts that building them must give."""

from pathlib import Path

SERVICE = {
    "README.md": "# Demo\nWords.\n## More\nText\n\nEnd\n",
    "guide.rst": "Guide\n=====\n\nBody\n",
    "settings.toml": "[app]\nname = 1\n",
    "pkg/__init__.py": '"""Package."""\n',
    "pkg/tools.py": 'PREFIX = "Hi"\n\n\ndef tidy(name):\n    return name.strip()\n\n\nasync def load(user_id):\n    return tidy(user_id)\n',
    "pkg/api.py": "from fastapi import FastAPI\n\nfrom tools import PREFIX, load, tidy\n\napp = FastAPI()\n\n\nclass Greeter:\n    def hello(self, name):\n        return self._log(tidy(name))\n\n    def _log(self, text):\n        return PREFIX + text\n\n\n@app.get(\"/users/{user_id}\")\nasync def get_user(user_id):\n    return await load(user_id)\n\n\n@app.post(\"/users\")\ndef make_user(name):\n    return tidy(name)\n",
    "tests/TestApi.py": "__test__ = False\n\n\ndef test_greeter():\n    assert True\n",
}

TWINS = {
    "one.py": "from flask import x\n\nBASE = 1\n\n\nclass Base:\n    def run(self):\n        return helper()\n\n\ndef helper():\n    return BASE\n",
    "two.py": "import one as first\n\n\nclass Child(Base):\n    def run(self):\n        return helper()\n\n\ndef helper():\n    return 2\n\n\ndef test_helper():\n    helper()\n",
}


def make(root: Path, files: dict) -> str:
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)
