"""Facts of the rules: hints, composed answers, replies, calibration."""

import pytest
from pyspark.sql import functions as F

from granary.functions import rules, text
from granary.operators import compose, grounding

HINTS = [
    ("外卖员把别家的饭送错到我这里", "错送餐品"), ("有人打电话要我报校验码", "验证码诈骗提醒"), ("店家到现在没接单，那我不要了，可以取消吗", "取消订单"), ("配送员叫我微信上另付路费", "私下收费风险"),
    ("申请的退款现在走到哪一步", "退款进度"), ("粥洒了一袋子，怎么申请售后", "餐品撒漏售后"), ("页面写已送达，我下楼没拿到", "未收到餐"), ("送达时间越来越晚是怎么回事", "配送异常追问"), ("支付失败却扣款，钱去哪了", "退款失败"),
    ("给店家留言一直没回复，平台能帮忙催一下吗", "联系商家咨询"), ("下单用了旧地址，骑手快到了能改送新家吗", "地址修改追问"), ("晚了四十分钟，有补偿吗", "延误补偿"), ("两杯奶茶缺少一杯", "少送漏送"),
    ("吃坏了但没留证据，还能赔偿吗", "食品安全投诉"), ("那个配送员态度不好", "骑手态度投诉"), ("没收到餐，可以全额退款吗", "未收到餐"), ("店家取消的单子什么时候退回", "退款进度"), ("商家刚接单，能不能取消", "接单后取消"),
    ("你保证这单不会扣钱", "退款金额咨询"), ("骑手打不通", "配送异常追问"), ("满减券今天用不了", "优惠券不可用"), ("我想问少退的那部分", "退款金额咨询"), ("钱多久退，我就想问这个", "退款进度"), ("骑手知道我的手机号吗", "隐私保护咨询"),
    ("平台客服会查手机号吗", "隐私保护咨询"), ("客服联系商家行吗", "联系商家咨询"), ("骑手显示到了可定位不对", "配送异常追问"), ("商家电话是多少", "商家电话咨询"), ("没用餐怎么还扣了钱", "退款金额咨询"),
    ("送错了还少送一份", "错送餐品"), ("缺少发票", ""), ("今天天气不错", ""),
]


def test_hints(spark):
    rows = spark.createDataFrame(HINTS, "query string, want string").withColumn("got", rules.intent_hint(F.col("query")))
    assert [(r.query, r.got) for r in rows.collect()] == HINTS


COMPOSED = [
    ("红包结算时抵不了", "看一下红包写明的条件，多半是今天的单子不符合其中一条，页面上会写原因。您别生气，慢慢看。", "优惠券不可用", "红包有使用门槛和有效期。先点开红包看原因。条件都满足还抵不了，就截图反馈。", ["使用门槛", "优惠券详情"], None),
    ("我取消的那单什么时候到账", "我取消的那单什么时候到账？", "退款进度", "钱按支付渠道原路退回，快慢要看银行，进度在订单详情页。", ["支付渠道"], "low_quality_model_reply"),
    ("有人要我把验证码念给他，能不能念", "别念。", "验证码诈骗提醒", "不可以念给任何人。有事请联系官方客服渠道，不要私下说。", ["^不可以", "官方客服渠道"], None),
    ("店家半天没接单，我不想要了", "能取消。", "取消订单", "在订单详情页点取消。点不动就找平台客服。", ["订单详情页", "平台客服"], None),
    ("你们平台客服查得到手机号吗", "查不到。", "隐私保护咨询", "号码由隐私号保护，请用平台内联系功能。", ["不需要主动提供完整手机号", "平台内联系功能", "隐私号"], None),
    ("退下来的钱怎么少了一截", "得看单子。", "退款金额咨询", "少退的部分和制作、配送有关。扣除原因写在退款详情页。", ["退款详情页"], None),
    ("我压根没用餐，为什么扣钱", "x", "退款金额咨询", "可能店家已经做了。", ["^没吃上但仍被扣款或只退部分金额", "退款详情页", "平台介入"], None),
    ("饭没到手还收我配送费，合理吗", "x", "退款金额咨询", "可能店家已经做了。", ["^不能直接判断扣配送费是否合理", "售后复核"], None),
    ("退回来的钱扣了配送费", "x", "退款金额咨询", "可能店家已经做了。", ["^餐没拿到但仍被扣配送费", "退款详情页"], None),
    ("要店主电话，我自己打", "x", "商家电话咨询", "电话在页面上看。", ["^不能直接提供页面未展示的店家手机号", "联系商家", "虚拟号"], None),
    ("说了别放葱，还是放了", "x", "备注未满足", "走售后。", ["^如果已备注不要葱", "订单备注截图"], None),
    ("香菜写了不要也给我加", "x", "备注未满足", "走售后。", ["^如果已备注不要香菜", "订单备注截图"], None),
    ("对花生过敏，里面却有花生", "x", "备注未满足", "走售后。", ["^如果已备注过敏", "停止食用"], None),
    ("写明了忌口，店里没当回事", "x", "备注未满足", "走售后。", ["^如果已写明忌口或过敏备注", "餐品照片"], None),
    ("送餐的打不通", "x", "配送异常追问", "找骑手。", ["^骑手联系不上时", "配送异常反馈"], None),
    ("他说已到，可位置差得远", "x", "配送异常追问", "找骑手。", ["^骑手说已到但定位仍很远"], None),
    ("饭没来，能退吗", "x", "未收到餐", "先找找。", ["^骑手取餐后一直没收到餐"], None),
    ("饭没来，保证退我", "x", "未收到餐", "先找找。", ["^不能直接承诺全额退款", "无法立即取回餐品", "平台核实处理为准"], None),
    ("承诺一个到账的日子", "x", "退款进度", "看进度。", ["^不能直接承诺全额退款或具体到账时间", "原路退回"], None),
    ("承诺把少的钱都退给我", "x", "退款金额咨询", "看详情。", ["^不能直接承诺平台全额退款", "扣除原因"], None),
    ("晚到一小时，保证补我钱", "x", "延误补偿", "看入口。", ["^不能保证超时后都会赔钱", "补偿入口"], None),
    ("漏的那份马上给我送来", "x", "少送漏送", "走售后。", ["^不能直接承诺由商家立即补送", "小票"], None),
    ("汤里有虫，保证赔", "x", "食品安全投诉", "走售后。", ["^需要通过订单售后提交食品安全投诉", "停止食用"], None),
    ("保证罚那个骑手", "x", "骑手态度投诉", "走投诉。", ["^不能保证处罚骑手或赔偿", "骑手服务投诉"], None),
    ("已经接单了，保证取消不扣", "x", "接单后取消", "看状态。", ["^不能保证商家接单后取消一定不扣钱", "页面显示"], None),
    ("红包没用上，补偿我", "x", "优惠券不可用", "看条件。", ["^不能直接判断平台会补偿", "截图"], None),
    ("抬头怎么开", "x", "发票开具咨询", "看页面。", ["^发票可以先在订单详情页", "没有入口"], None),
    ("帮我打电话要回退款", "x", "联系商家咨询", "看页面。", ["^平台客服不能绕过平台直接联系商家要求退款", "聊天记录"], None),
    ("帮我打给店里", "x", "联系商家咨询", "看页面。", ["^平台客服不能绕过平台直接代打给店家", "聊天记录"], None),
    ("商家手里有我的手机号吗", "x", "隐私保护咨询", "看规则。", ["^商家一般不应直接看到您的真实手机号"], None),
    ("随便问", "", "没有规则的意图", "", ["建议您先在订单详情页查看当前状态。"], "low_quality_model_reply"),
]


def test_composed_answers(spark):
    rows = compose.compose(spark.createDataFrame([c[:4] for c in COMPOSED], "query string, reply string, intent string, answer string")).collect()
    wrong = []
    for r, (query, _, _, _, wanted, reason) in zip(rows, COMPOSED, strict=True):
        wrong += [(query, w, r.composed_reply) for w in wanted if not (r.composed_reply.startswith(w[1:]) if w[0] == "^" else w in r.composed_reply)]
        wrong += [(query, reason, r.composer_reason)] if reason not in (None, r.composer_reason) else []
    assert wrong == []
    assert "您别生气" not in rows[0].composed_reply
    # the required action and caveat replace those of an edit
    assert rows[10].answer_parts.action.startswith("提交售后时建议您上传")


def test_reply_rules(spark):
    cases = [("随便问问", "原话", "配送", "催单", "原话"), ("这单退款失败怎么回事", "原话", "退款", "退款失败", "退款失败可能与"), ("你能保证吗", "不能乱说", "投诉", "骑手态度投诉", "不能乱说"), ("饭没来，能退吗", "原话", "配送", "未收到餐", "骑手取餐后一直没收到餐"), ("他说已到，位置不对", "原话", "配送", "配送异常追问", "骑手说已到但定位仍很远")]
    rows = compose.reply_rules(spark.createDataFrame([c[:4] for c in cases], "query string, reply string, category string, intent string")).collect()
    for r, c in zip(rows, cases, strict=True):
        assert r.ruled_reply.startswith(c[4]), (r.ruled_reply, c)
    assert rows[0].rules_trace.mode == "pass_through" and rows[1].rules_trace.mode == "force" and rows[1].rules_trace.matched_keyword == "退款失败"


def test_judgements_and_calibration(spark):
    raws = ['{"direct_answer": "Y", "grounded": "true", "useful": "part", "risk_notes": "", "reason": ""}', "", "no json", '{"direct_answer": "yes"}', '{"direct_answer": "yes", "grounded": "maybe", "useful": "yes", "risk_notes": "", "reason": "r"}']
    got = grounding.parsed_judgement(spark.createDataFrame([(x,) for x in raws], "raw_judge_response string")).collect()
    assert [r.judge_failure_type for r in got] == ["", "empty_response", "not_json", "missing_field", "invalid_enum"]
    assert tuple(got[0].judge_result)[:3] == ("yes", "yes", "partial") and got[0].judge_result.reason == "judge returned valid scores without reason"
    rows = spark.createDataFrame([
        ("退款多久到账", "退款按支付渠道原路退回，可在订单详情页查看", "退款进度", ["支付渠道 原路退回 订单详情页"], ("no", "partial", "yes", "", "r")),
        ("发票", "订单详情页的申请发票入口，联系商家", "发票开具咨询", ["订单详情页 申请发票入口 商家"], ("no", "partial", "yes", "", "r")),
        ("别的", "别的", "别的", ["x"], ("no", "partial", "yes", "", "r")),
    ], "query string, reply string, expected_intent string, retrieved_documents array<string>, judge_result struct<direct_answer string, grounded string, useful string, risk_notes string, reason string>")
    got = grounding.calibrated(rows).collect()
    assert [tuple(r.judge_result)[:3] for r in got] == [("yes", "partial", "yes"), ("yes", "yes", "yes"), ("no", "partial", "yes")]
    assert [r.calibrations for r in got] == [["refund_time"], ["invoice_entry"], []]
    assert got[0].judge_result.reason.startswith("r Calibrated: reference documents")


def test_masking(spark):
    t = "手机号13812345678，验证码：123456，订单1234567890123456"
    got = spark.createDataFrame([(t,), (None,)], "t string").select(text.masked(F.col("t")).alias("m")).collect()
    assert got[0].m == "手机号[手机号已脱敏]，验证码[已脱敏]，订单[订单号已脱敏]" and got[1].m == ""


def test_forbidden_words_in_harmless_context(spark):
    row = spark.createDataFrame([("请不要私下转账。", ["私下转账"]), ("可以私下转账。", ["私下转账"])], "r string, f array<string>")
    assert [list(x.h) for x in row.select(text.forbidden_hits(F.col("r"), F.col("f")).alias("h")).collect()] == [[], ["私下转账"]]


@pytest.mark.parametrize("base, want", [("http://a/v1/", "http://a/v1/chat/completions"), ("http://a/v1/chat/completions", "http://a/v1/chat/completions")])
def test_completions_url(base, want):
    assert text.completions_url(base) == want
    with pytest.raises(ValueError):
        text.completions_url(" ")
