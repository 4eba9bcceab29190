import pytest

from weftlight.llm import sentences as S
from weftlight.sources.tables import table


@pytest.fixture(scope="module")
def scores(spark, small):
    return S.fit_scores(S.cut_table(table(spark, small.replace("0.001", "0.01"), "documents")))


def cut(text, scores):
    return [text[a:b] for a, b in S.sentence_units(text, scores)]


@pytest.mark.parametrize("units", [
    ["Dr. Haverin checked the bridge at 5 p.m. and again at 73.93 minutes past.", "The gate at Brovik closes at 6 p.m.", "Most of it is built around one mill."],
    ['"It works. I tried it," said Mrs. Tavesh about the signal.', "Why did the kettle stop?!", "(The shelf is shown on p. 21.)", "“Who left the shelf open?” asked Tavesh from the ferry."],
    ["Der Kessel fasst ca. 4,5 Liter, d. h. mehr als der Schuppen.", "„Wer hat den Fahrplan geöffnet?“, fragte Havering leise.", "Dr. Belstadt kam am 17. Oktober und prüfte z. B. den Kessel."],
    ["« Qui a laissé le four ouvert ? » demanda Quorin.", "Voir p. 13 et fig. 13 du dossier !", "M. Ordan a vu le tunnel à 17 h 30 et n'a rien dit."],
    ["El Sr. Ordán vio el puerto a las 5 p. m. y no dijo nada.", "¿Quién dejó abierto el motor de Dunmera?", "¡Cuidado con el túnel de la Dra. Mirela!"],
])
def test_spaced_scripts(units, scores):
    assert cut(" ".join(units), scores) == units


@pytest.mark.parametrize("units", [
    ["去年冬天，邓米尔的花园几乎无法到达。", "小心仓库！", "“花园能用。我试过了。”米雷利说。", "是谁让港口开着的？"],
    ["「橋は動きます。もう試しました。」とミレリさんは言いました。", "庭園に気をつけて！", "だれが橋を開けたままにしたのですか？"],
])
def test_scripts_without_spaces(units, scores):
    assert cut("".join(units), scores) == units


def test_thai_gaps(scores):
    units = ["ใครเปิดท่าเรือทิ้งไว้?", "สวนจุน้ำได้ราว87.72ลิตร", "เมื่อสะพานเต็มเซิร์ฟเวอร์จะรอจนกว่าจะมีคนเทออก"]
    assert cut(" ".join(units), scores) == units


def test_blocks_and_wraps(scores):
    text = "A short history of Boats\n\nWe measured the museum for 810 days and wrote every value in\nthe ferry. Nobody had asked why the ledger kept losing its\nbarrel\n\n• boat, Dunmere\n\n2. We measured the mill. It was full.\n\nBackground"
    assert cut(text, scores) == [
        "A short history of Boats", "We measured the museum for 810 days and wrote every value in\nthe ferry.", "Nobody had asked why the ledger kept losing its\nbarrel",
        "• boat, Dunmere", "2. We measured the mill. It was full.", "Background",
    ]
    assert cut("Visiting a boat\r\nThe mill was moved. Readers know it.", scores) == ["Visiting a boat", "The mill was moved.", "Readers know it."]


def test_missing_space(scores):
    assert cut("The museum came later.See fig. 1 and vol. 1 of the ferry register.", scores) == ["The museum came later.", "See fig. 1 and vol. 1 of the ferry register."]


def test_every_character_belongs_to_one_unit(spark, small, scores):
    for row in table(spark, small, "documents").select("text").collect():
        text = row["text"] or ""
        spans = S.sentence_units(text, scores)
        covered = [c for a, b in spans for c in text[a:b] if not c.isspace()]
        assert covered == [c for c in text if not c.isspace()]
        assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_dirty_rows(spark):
    rows = [(1, "The mill was moved here. Readers know it well."), (1, "The mill was moved here. Readers know it well."), (2, None), (3, ""), (4, " \n\t "), (None, "x"), (5, "😀 ok. 𝔘nit two."), (6, "A b. " * 20000), (7, "no end"), (8, "...")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as start_char")
    found = S.sentence_spans(frame).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    assert set(by_id) == {1, 5, 6, 7, 8} and sorted(by_id[1]) == [(0, 24), (25, 46)]
    assert sorted(by_id[7]) == [(0, 6)] and sorted(by_id[8]) == [(0, 3)]
    assert S.sentence_spans(frame.limit(0)).count() == 0


def counted_plainly(texts):
    """{(kind, key): [cuts, no cuts]} where only the ends of blocks are cuts, word by word."""
    counts = {}

    def add(kind, key, cut):
        counts.setdefault((kind, key), [0, 0])[0 if cut else 1] += 1

    for text in texts:
        for a, b in S.blocks(text):
            block = text[a:b]
            if S._MARKER.match(block):
                continue
            found = S.candidates(block)
            taken = {s for _, s in found}
            add("open", S.opening_key(block, 0), True)
            if S._ends(block):
                add("close", S.closing_key(block, 0, len(block)), True)
            for m in S._WORD.finditer(block):
                if m.start() and m.start() not in taken:
                    add("open", S.opening_key(block, m.start()), False)
            for e, s in found:
                if not S._END.match(block[e - 1]):
                    add("open", S.opening_key(block, s), False)
                add("close", S.closing_key(block, 0, e), False)
    return counts


def test_scores_are_learned_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_KEYS", 50)
    # an abbreviation of one rare source, in 30 of 6,000 documents
    rows = [(i, "The mill was moved. It was full.\n\n2. Not counted." if i % 200 else "It is in rubr. Velmora and rubr. Karruth now. “No.” ถาม ตอบ") for i in range(6000)]
    read = S.cut_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    made = S.fit_scores(read)
    assert made.closing("rubr.") < S.closing_prior("rubr.") and made.opening("It") > made.opening("mill")
    whole = {(kind, S.hashed(key)): tuple(n) for (kind, key), n in counted_plainly(text for _, text in rows).items()}
    assert {(r["kind"], r["key"]): (r["yes"], r["no"]) for r in S.key_counts(read, None).collect()} == whole


def test_keys_above_a_support(spark):
    counts = spark.createDataFrame([("open", f"k{i}", i % 5, 1) for i in range(50)], "kind string, key string, yes long, no long")
    assert S.supported(counts, 50).count() == 50
    assert {r["yes"] for r in S.supported(counts, 25).collect()} == {3, 4}
    assert S.supported(counts, 5).count() == 0


def best_over_all_starts(block, scores):
    """(total of the chosen spans, best total), the second by trying every start of every span."""
    _, blocks, cuts = S.cuts_of([block], S.Reader())
    assert len(blocks["dense"]) == 1
    starts, ends = [0, *cuts["s"].tolist()], [*cuts["e"].tolist(), len(block)]
    gain = [0.0, *(scores.of("open", cuts["opens"], cuts["open_prior"]) + scores.of("close", cuts["closes"], cuts["close_prior"])).tolist()]
    before, after = [0, *cuts["before"].tolist()], [*cuts["after"].tolist(), int(blocks["state_end"][0])]

    def value(i, j):
        z = (S.math.log(max(ends[j] - starts[i], 1)) - S.LENGTH) / S.LENGTH_SPREAD
        return gain[i] - S.LENGTH_WEIGHT * min(z * z, S.LENGTH_CAP) - S.UNBALANCED * (before[i] != after[j])

    best = [0.0]
    for j in range(len(ends)):
        best.append(max(best[i] + value(i, j) for i in range(j + 1)))
    chosen = [0, *(S.np.flatnonzero(S.chosen_cuts(blocks, cuts, scores)) + 1).tolist(), len(ends)]
    return sum(value(i, j - 1) for i, j in zip(chosen, chosen[1:], strict=False)), best[-1]


def test_a_span_passes_over_any_number_of_cuts(scores):
    line = "The history of the mill " + ". " * 200 + "17"
    assert cut(line, scores) == [line]
    pieces = ["The mill was moved. ", "See vol. 3 and p. 21 of it. ", '"It works', ' well." ', "Dr. Haverin came. . . . ", "(it is full. ", "no.) ", "« Qui a dit. », "]
    for size in (4, 11, 29, 90):  # blocks that are cut together, and one by itself
        for k in range(8):
            block = "".join(pieces[(i * i * (k + 1) + i // 3 + k) % len(pieces)] for i in range(size)).strip()
            ours, theirs = best_over_all_starts(block, scores)
            assert abs(ours - theirs) < 1e-6


def test_blocks_are_cut_alike_alone_and_together(scores):
    pieces = ["The mill was moved. ", "Dr. Haverin came. ", '"It works', ' well." ', "(it is full. ", "no.) "]
    texts = ["".join(pieces[(i * (k + 1) + k) % len(pieces)] for i in range(1 + k % 40)).strip() for k in range(120)]
    count, blocks, cuts = S.cuts_of(texts)
    block, start, end = S.spans_of(blocks, cuts, S.chosen_cuts(blocks, cuts, scores))
    of_text = S.np.repeat(S.np.arange(len(texts)), count)[block]
    for i, text in enumerate(texts):
        assert list(zip(start[of_text == i].tolist(), end[of_text == i].tolist(), strict=True)) == S.sentence_units(text, scores)


def test_keys_that_are_not_sent_count_as_well(spark, small):
    # an abbreviation and a name that most other keys are better supported than
    rare = [(i, "It is in rubr. Velmora now. The mill was moved. It was full." if i % 3 else "The mill was moved. It is full. ถาม ตอบ") for i in range(24)]
    rows = [*rare, *((100 + i, t) for i, t in enumerate(["A line without cuts", "", None, "No. The mill of Dr. Haverin was full. “No.” It is in rubr. Karruth."]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(table(spark, small, "documents").selectExpr("doc_id + 1000 as doc_id", "text")).repartition(3)
    whole = {tuple(r) for r in S.sentence_spans(frame).collect()}
    for most in (0, 30, 400):
        found = [tuple(r) for r in S.sentence_spans(frame, max_keys=most).collect()]
        assert len(found) == len(whole) and set(found) == whole
    _, rest = S.learned(S.cut_table(frame), 30)
    assert rest.count() > 30


def test_the_driver_holds_a_bounded_number_of_keys_as_numbers(spark, small, monkeypatch):
    assert S.MAX_KEYS * 16 <= 8 << 20
    monkeypatch.delattr("pyspark.sql.classic.dataframe.DataFrame.toPandas")  # rows as objects where Arrow is not switched on
    read = S.cut_table(table(spark, small, "documents"))
    sent, rest = S.learned(read, 50)
    held = sum(len(keys) for keys, _ in sent.table.values())
    assert 0 < held <= 50 < rest.count()
