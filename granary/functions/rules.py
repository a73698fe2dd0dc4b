"""Rules as data, compiled to Column expressions.

A condition is a text of clauses joined by `&`. A clause is a field and the terms of which one must be contained:
`q:退款|退钱`; `!q:` if none may be; `i=` if the field must equal one. Fields: q query, r reply, d documents, i intent.
Several alternatives are joined by ` OR `.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import has_any


def condition(rule: str, fields: dict[str, Column]) -> Column:
    def clause(one: str) -> Column:
        one = one.strip()
        negated, one = one.startswith("!"), one.removeprefix("!")
        field, sign, terms = one[0], one[1], one[2:].split("|")
        c = fields[field].isin(*terms) if sign == "=" else has_any(fields[field], terms)
        return ~c if negated else c

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(clause, way.split(" & "))) for way in rule.split(" OR ")])


def first_match(rules: list[tuple[str, object]], fields: dict[str, Column], value=F.lit, default: Column | None = None) -> Column:
    """CASE over (condition, value) in order."""
    out = F
    for rule, result in rules:
        out = out.when(condition(rule, fields), value(result))
    return out.otherwise(F.lit("") if default is None else default)


#: Conditions on a query and the intent they hint at, in order of priority.
INTENT_HINTS = [
    ("q:送错|送错了|给错餐|不是我点的|收到的是别|收到别的", "错送餐品"),
    ("q:验证码|验正码|校验码", "验证码诈骗提醒"),
    ("q:商家|店家 & q:不接单|未接单|没接单|没接|半小时没接单 & q:取消|不想要", "取消订单"),
    ("q:骑手|骑首|配送员 & q:加微信|微信|私下|转钱|转运费|转配送费|转费用", "私下收费风险"),
    ("q:退我|退款|退钱|把钱退|钱退 & q:保证|现在|马上|投诉|多久到账|进度", "退款进度"),
    ("q:洒|撒|漏|洒烂|撒漏 & q:赔|售后|举证|凭证|照片|汤|餐|饭|包装", "餐品撒漏售后"),
    ("q:显示送达|显示送到了|已送达|送到了 & q:没收到|没拿到|没有餐|真没拿到|门口没有 OR q:放前台|放门口|放取餐柜 & q:没看到|没找到|没有|找不到", "未收到餐"),
    ("q:预计时间|送达时间|时间 & q:往后跳|一直变|一直往后|越来越晚", "配送异常追问"),
    ("q:付款失败|支付失败|没支付成功 & q:扣|扣款|被扣|扣了一次|去哪看进度", "退款失败"),
    ("q:商家|店家 & q:不回复|不回|没回复|一直不回复 & q:平台介入|催一下|联系|协助", "联系商家咨询"),
    ("q:地址写错|地址填错|地址写搓|地址写搓了|写成公司|旧地址|原地址|老地址 & q:骑手|配送员 & q:改送|改地址|到家|回家|快到|已经到|不在那", "地址修改追问"),
    ("q:超时|迟到|晚了|承诺时间 & q:赔|赔钱|赔偿|补偿", "延误补偿"),
    ("q:少送|漏送|少了一份|少送了一份|缺少|没送到 & !q:发票|优惠券|红包", "少送漏送"),
    ("q:没拍照|没有拍照|没包装|没有包装|没留证据 & q:赔|赔偿|能赔|一定能赔", "食品安全投诉"),
    ("q:骑手|配送员 & q:态度差|态度不好|说话太冲|发脾气", "骑手态度投诉"),
    ("q:没收到餐|没有收到餐|没拿到餐|没拿到 & q:退全款|全额退款|全款|退款", "未收到餐"),
    ("q:商家取消|店家取消|商家取消了|店家取消了 & q:退款|退钱|退回|全额退款|承诺", "退款进度"),
    ("q:商家|店家 & q:接单|开始做|已经做|制作|还没送 & q:不想要|取消|退全款|全款|全额退|强制全额|不扣钱|强制取消 & !q:不接单|未接单|没接单", "接单后取消"),
    ("q:全款|全额|扣除|扣钱|只退|少退 & q:一定|保证|承诺|直接说|截图", "退款金额咨询"),
    ("q:骑手|配送员 & q:联系不上|联系不到|打不通|电话不接|无法联系", "配送异常追问"),
    ("q:优惠券|红包|券 & q:不能用|用不了|没用上|不可用|无法使用|结算时不能用|不能抵|没抵|不抵|抵不了", "优惠券不可用"),
    ("q:不是问骑手|不是问商家|我想问|重点是 & q:扣费|扣钱|配送费|没全退|只退|少退 OR q:没收到|没拿到|没吃上|没用餐 & q:扣费|扣钱|配送费|没全退|只退|少退", "退款金额咨询"),
    ("q:钱什么时候退|钱啥时候退|钱多久退|多久到账|退回来 & q:重点|主要|想问|问的是|取消|超时", "退款进度"),
    ("q:真实手机号|看到我的手机号|看到我手机号|知道我的手机号|完整手机号", "隐私保护咨询"),
    ("q:平台客服 & q:手机号", "隐私保护咨询"),
    ("q:帮我打给|直接帮我打|直接私下打给|私下打给|私下替我打给|帮我联系|客服联系 & q:商家|店家", "联系商家咨询"),
    ("q:骑手 & q:说到了|显示到了|说已到 & q:定位|位置", "配送异常追问"),
    ("q:商家|店家 & q:手机号|联系电话|电话", "商家电话咨询"),
    ("q:没吃上|没收到|没用餐|取消|只退|少退 & q:扣钱|扣我钱|扣了钱|没全退|只退|少退", "退款金额咨询"),
]

#: Fixed value: terms by which a query asks for what cannot be promised.
GUARANTEE = "q:一定|保证|承诺|直接说|直接让|马上"

#: Name, whether partial scores are relaxed too, and the condition; the order is that in which reasons are appended.
CALIBRATION = [
    ("refund_time", False, "q:退款多久到账|退款什么时候到账|钱多久退回来|多久退回来|什么时候退|啥时候能退|啥时候退|什么时候能退 & d:支付渠道 & d:原路退回 & d:订单详情页|退款进度 & r:支付渠道 & r:原路退回|审核通过 & r:订单详情页|退款进度 OR i=退款进度 & q:退 & q:钱|款 & d:支付渠道 & d:原路退回 & d:订单详情页|退款进度 & r:支付渠道 & r:原路退回|审核通过 & r:订单详情页|退款进度"),
    ("safety_wording", False, "i=验证码诈骗提醒 & q:验证码|验正码|校验码 & r:不可以 & r:验证码 & r:不要发送|不要|不需要发送 & r:官方客服渠道|订单页面 OR i=私下收费风险 & q:私下|加微信|微信|转运费|转配送费 & r:不建议|不要|不可以 & r:官方渠道|平台订单结算页 OR i=隐私保护咨询 & q:手机号 & r:隐私号|隐私保护 & r:完整手机号|平台内联系功能"),
    ("merchant_phone", True, " OR ".join(f"{asks} & {way}" for asks in ("i=商家电话咨询", "q:商家电话|店家电话") for way in ("d:不能直接提供|未开放电话联系|虚拟号 & d:手机号|联系电话|商家电话 & r:不能直接提供|不能直接给|无法直接提供 & r:手机号|联系电话 & r:没有展示电话|未开放电话联系|虚拟号", "d:商家电话|联系商家入口 & d:订单详情页|商家主页 & r:商家电话 & r:订单详情页|商家主页 & r:联系商家 & r:没有展示电话|未开放电话联系|虚拟号"))),
    ("refund_amount_boundary", True, " OR ".join(f"i=退款金额咨询 & {asks} & d:退款详情页|退款详情 & d:扣除原因|退款金额|只退部分金额|部分退款 & d:已制作|配送|优惠券|平台规则|售后复核|平台核实 & r:退款详情页 & r:扣除原因|平台核实结果|已制作|配送|优惠券|平台规则 & r:售后复核|核实处理|核实" for asks in ("q:餐没拿到|餐未收到|没收到餐|餐没收到 & q:配送费|扣", "q:只退|少退|退这么点|扣钱|扣了|没全退", "q:全款|全额|全额退款 & q:一定|保证|承诺|直接说|截图"))),
    ("invoice_entry", True, "i=发票开具咨询 & d:订单详情页 & d:申请发票入口 & d:商家|订单类型|平台客服 & r:订单详情页 & r:申请发票入口 & r:商家|订单类型|平台客服"),
    ("coupon_compensation", True, "i=优惠券不可用 & q:补我|补偿|赔|赔我|赔一张 & d:使用门槛|有效期|适用品类|支付方式|优惠券详情|结算页 & d:截图|反馈|核实|不可用原因 & r:不能直接判断平台会补偿|不能直接承诺平台补偿|不能直接赔 & r:使用门槛|有效期|适用品类|支付方式|结算页 & r:截图|反馈|核实"),
    ("delay_compensation", True, "i=延误补偿 & q:赔|补偿|延误补偿 & d:恶劣天气|承诺送达时间 & d:补偿入口 & d:配送延迟反馈 & r:不能保证|是否补偿 & r:承诺送达时间 & r:补偿入口 & r:配送延迟反馈 & r:平台核实"),
    ("contact_assistance", True, "i=联系商家咨询 & q:帮我打|直接帮我打|直接私下打给|私下打给|打给店家|打给商家 & d:协助联系商家核实 & d:联系商家 & d:聊天记录 & r:不能直接代您私下打|不能直接帮您私下打|不能绕过平台直接 & r:协助联系商家核实 & r:聊天记录"),
    ("cancel_boundary", True, "i=接单后取消 & q:保证|承诺|不扣钱|全额退款|全额退|强制全额 & q:接单|还没送|取消|强制 & d:订单状态|是否制作|页面展示|页面显示|商家确认 & d:能否取消|退款金额|全额退款|取消结果 & r:不能保证|需要以|以订单状态 & r:订单状态|是否制作|商家确认 & r:页面展示|页面显示"),
    ("picked_up_cancel", True, "i=取餐后取消 & q:取餐|已取餐 & q:取消|退款|不想要 & d:已取餐|取餐后|骑手已经取餐 & d:订单状态|联系骑手|售后申请|取消入口 & r:取餐后|已取餐 & r:不支持直接取消|能否取消或退款|订单状态 & r:联系骑手|售后申请|取消入口"),
    ("missing_food_refund", True, "i=未收到餐 & q:一定|保证|承诺|直接说 & q:退全款|全额退款|全款 & d:未收到餐 & d:订单详情页|提交|反馈 & d:核实|订单状态|送达情况 & r:不能直接承诺|不能保证|需要先由平台核实 & r:未收到餐 & r:订单详情页 & r:核实处理为准|平台核实|核实结果"),
    ("missing_item_boundary", True, "i=少送漏送 & q:补送|马上|直接让 & d:少送|漏送|缺少 & d:拍照 & d:小票|售后|凭证 & r:不能直接承诺|需要先提交售后 & r:补送|少送漏送 & r:拍照 & r:小票 & r:售后"),
    ("missing_item_standard", True, "i=少送漏送 & d:少送|漏送|缺少 & d:拍照 & d:小票|售后|凭证 & r:少送|漏送 & r:订单 & r:售后 & r:拍照 & r:小票 & r:凭证"),
    ("wrong_item_standard", True, "i=错送餐品 & d:错餐|送错餐|实际收到 & d:拍照 & d:包装 & d:订单小票 & r:送错餐品|餐品错误 & r:订单详情页 & r:售后 & r:拍照 & r:实际收到 & r:订单小票"),
    ("rider_complaint", True, "i=骑手态度投诉 & q:处罚|赔偿|保证 & d:骑手服务投诉 & d:订单详情页 & d:核实处理 & r:不能保证处罚|不能保证 & r:骑手服务投诉 & r:订单详情页 & r:平台核实"),
    ("food_safety_evidence", True, "i=食品安全投诉 & q:没拍照|没包装|没有拍照|没有包装|异物|食品安全|餐里 & q:赔|赔付|能赔 & d:停止食用 & d:拍照保留|餐品和包装|诊断记录 & d:食品安全投诉|食品安全反馈 & d:核实 & r:不能在没有凭证|不能直接承诺|不能保证|不能在没有凭证和核实结果前承诺赔付 & r:停止食用 & r:食品安全投诉 & r:核实"),
    ("food_safety_platform_flow", True, "i=食品安全投诉 & q:异物|异勿|塑料片|平台会怎么处理|赔 & d:停止食用 & d:拍照保留|餐品和包装|食品安全投诉 & d:核实 & r:订单售后 & r:食品安全投诉 & r:平台会结合凭证 & r:核实处理 & r:停止食用"),
]


def intent_hint(query: Column, rules: list[tuple[str, str]] = INTENT_HINTS) -> Column:
    """The intent that a query hints at, or an empty text."""
    return first_match(rules, {"q": query})
