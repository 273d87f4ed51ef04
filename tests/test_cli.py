import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SHEET = """NoticeId,Title,Type,PostedDate,ResponseDeadLine,TypeOfSetAsideDescription,NaicsCode
A-1,"Engine parts, 8(a)",Solicitation,02/01/1998,1998-02-10,SDVOSB set-aside,541512
A-2,Generator,Sources Sought,1998-01-20,1998-03-30,Women-Owned,541511
A-3,Fuel,Award Notice,1998-02-02,1998-02-05,None,541512
"""


def test_cli_run(tmp_path):
    (tmp_path / "sheet.csv").write_text(SHEET)
    (tmp_path / "plan.json").write_text(json.dumps(
        {"filters": [{"column": "Due Date", "operator": "next_days", "value": 14}],
         "summary_by": ["NAICS", "Agency"]}))
    out = subprocess.run(
        [sys.executable, "-m", "bidscope", "--master", "local[2]", "run",
         str(tmp_path / "sheet.csv"), str(tmp_path / "plan.json"), str(tmp_path / "out"),
         "--today", "1998-02-04"],
        cwd=ROOT, capture_output=True, text=True, timeout=600)
    res = json.loads(out.stdout.strip().splitlines()[-1])
    assert res["rows"] == 1 and res["sheets"] == {"Filtered": 1, "Summary": 1}
    assert any("Agency" in n for n in res["notes"])
