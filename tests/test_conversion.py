import pytest

from quillon.operators import conversion as cv

EXPERIENCE = r"""\begin{itemizeAcademic}{Mom Corp}{Captain \\ Delivery}{New New York}{Jan 3000 -- Present}
  \itemi Delivered \textbf{many} things, 5\% late
  \itemi[\faStar] With a star
  \begin{itemizeKeyProject}{\faRocket}{Ship}{3001}
    \itemii Built {a} ship
  \end{itemizeKeyProject}
\end{itemizeAcademic}"""
DOCUMENT = r"""\documentclass{resume}
\usepackage[x]{geometry}
\definecolor{main}{HTML}{FF0000}
\setlength{\columnsep}{3pt}
\renewcommand{\name}{\textbf{P. J. {Fry}}}
\begin{document}
\begin{paracol}{2}
\leftgrad{a}{b}{c}{d}{e}
\begin{textblock*}{3cm}(1cm,2cm) note \end{textblock*}
\section*{Core Skills}
{ \setlength{\baselineskip}{10pt} \setlength{\parskip}{7.5pt} \scshape
  One

  Two \\ more
}
\section*{Languages}
C | \texttt{Rust} | Python
\vspace{4pt}
\section*{Alias}
\begin{itemizeMain}[leftmargin=1pt]
\itemLL a \itemLL b
\end{itemizeMain}
\switchcolumn
\section*{Experience}
""" + EXPERIENCE + r"""
\section*{Tools}
\begin{itemize}
\item[\faCode] Code \begin{itemizeLL} \itemLL x \itemLL y \end{itemizeLL}
\item[\faDb] Data \begin{itemizeLL} \itemLL z \end{itemizeLL}
\end{itemize}
\end{paracol}
\clearpage
\section*{Projects}
\begin{itemizeProjMain}
\begin{itemizeAProject}{s}{P1}{now} \itemi did \end{itemizeAProject}
\end{itemizeProjMain}
\section*{Education}
\begin{itemize} \item[\faGrad] University of Mars, Dissertation \end{itemize}
\section*{Highlights}
\begin{itemize} \item first \item second \end{itemize}
\section*{Odd}
plain words
\end{document}
"""


def test_document():
    d = cv.read_document(DOCUMENT)["document"]
    assert d["metadata"]["fields"] == {"name": r"\textbf{P. J. {Fry}}"} and d["metadata"]["packages"] == [["x", "geometry"]] and d["metadata"]["colors"] == {"main": ["HTML", "FF0000"]}
    first, second = d["pages"]
    assert first["decorations"] == [{"command": "leftgrad", "arguments": list("abcde")}] and "note" in first["textblock"]
    left, main = (first["regions"][r]["sections"] for r in cv.COLUMNS)
    assert [s["type"] for s in left] == ["skill_list_caps", "skill_list_pipes", "personality_alias_array"]
    assert [i["latex_raw"] for i in left[0]["content"]["items"]] == ["One", r"Two \\ more"] and left[1]["metadata"]["spacing_after"] == "4pt"
    assert [i["plaintext"] for i in left[1]["content"]["items"]] == ["C", "Rust", "Python"]
    assert left[2]["metadata"]["arguments"] == "[leftmargin=1pt]" and [b["latex_raw"] for b in left[2]["content"]["bullets"]] == ["a", "b"]
    job = main[0]["subsections"][0]
    assert job["metadata"] == {"company": "Mom Corp", "title": "Captain", "subtitle": "Delivery", "location": "New New York", "dates": "Jan 3000 -- Present"}
    assert [b["plaintext"] for b in job["content"]["bullets"]] == ["Delivered many things, 5% late", "With a star"]
    assert job["content"]["projects"][0]["metadata"]["name"] == "Ship"
    assert [(s["metadata"]["name"], len(s["content"]["bullets"])) for s in main[1]["subsections"]] == [("Code", 2), ("Data", 1)]
    assert [s["type"] for s in second["regions"]["main_column"]["sections"]] == ["projects", "education", "custom_itemize", "unknown"]


def test_round_trips():
    for text in (DOCUMENT, EXPERIENCE):
        node = cv.read_document(text)
        written = cv.write_document(node)
        assert cv.read_document(written) == node
        assert cv.write_document(cv.read_document(written)) == written
    with pytest.raises(ValueError):
        cv.read_document("nothing")


def test_columns(spark):
    rows = spark.createDataFrame([(1, DOCUMENT), (2, "nothing"), (3, None), (4, EXPERIENCE)], "k int, t string")
    got = {r.k: (r.error is not None, r.same, r.n_pages, r.n_sections) for r in cv.round_trip(rows, "k", "t").collect()}
    assert got[1] == (False, True, 2, 9) and got[2][:2] == (True, False) and got[3][:2] == (False, False) and got[4][:2] == (False, True)
