"""Word lists, reply texts, constants and formats that results depend on literally, in their natural order."""

#: Words of no weight.
STOP_WORDS = ('a', 'an', 'and', 'are', 'can', 'how', 'i', 'is', 'of', 'the', 'to', 'what', 'your')

#: Terms that count wherever they are contained.
DOMAIN_KEYWORDS = ('优惠券', '会员', '取消', '售后', '商家', '外卖', '投诉', '支付', '红包', '订单', '评价', '账号', '超时', '退款', '配送', '隐私', '食品安全', '骑手')

#: Trigger and the terms that it adds.
QUERY_EXPANSIONS = {
    '异物': ('售后', '投诉', '食品', '食品安全', '餐品'),
    '食品': ('售后', '投诉', '食品安全', '餐品'),
    '联系不上': ('客服', '打不通', '投诉', '无法联系', '订单', '配送', '配送异常', '骑手'),
    '无法联系': ('客服', '打不通', '投诉', '联系不上', '订单', '配送', '配送异常', '骑手'),
    '打不通': ('无法联系', '联系不上', '订单', '配送', '配送异常', '骑手'),
    '多久到账': ('到账', '支付', '进度', '退款'),
    '多久到': ('到账', '支付', '进度', '退款'),
}

#: Points of a matched term by field.
FIELD_WEIGHTS = {
    'intent': 5,
    'category': 3,
    'question': 2,
    'answer': 1,
}

#: Bonus of a keyword by field.
BONUS_FIELDS = {
    'intent': 0.04,
    'category': 0.03,
    'question': 0.02,
    'answer': 0.01,
}

#: Weight of a keyword that query and field contain.
BONUS_KEYWORDS = {
    '退款': 1.0,
    '到账': 1.0,
    '进度': 0.8,
    '会员': 0.3,
    '退回来': 1.0,
    '退钱': 1.0,
    '钱': 0.6,
    '多久': 0.5,
    '餐品': 1.0,
    '异物': 1.2,
    '食品': 1.0,
    '安全': 1.0,
    '变质': 1.0,
    '售后': 0.8,
    '投诉': 0.8,
    '赔': 0.6,
}

#: Keywords of the four toy dimensions.
TOY_DIMENSIONS = [['退款', '退钱', '到账', '取消'], ['配送', '超时', '骑手', '外卖'], ['优惠券', '红包', '会员'], ['食品', '异物', '安全', '变质']]

#: Keywords and the reply they select, in order of priority.
REPLY_RULES = [
    (('退款进度',), '取消后如已支付，退款进度以订单详情页展示为准。到账时间会受支付渠道处理影响，建议您先在订单详情页查看退款状态；如果页面没有明确进度，可以联系平台客服核实，具体结果以订单页面和平台处理结果为准。'),
    (('退款金额咨询',), '订单取消后只退一部分，通常可能与商家是否已制作、配送是否已开始、优惠券抵扣或平台规则有关。建议您先在退款详情页查看扣除原因；如果对金额有疑问，可以在订单内补充相关说明并提交售后复核，具体结果以页面展示和平台核实为准。'),
    (('退款失败',), '退款失败可能与订单状态、支付渠道或审核结果有关。建议您先查看页面展示的失败原因；如果页面没有明确说明，可以重新提交退款申请，或通过订单页联系平台客服核实处理。'),
    (('商家拒绝退款',), '如果您认为商家拒绝退款不合理，可以在订单内补充照片、聊天记录等凭证，并申请平台介入。平台会结合订单状态、问题类型和证据进行核实处理，建议处理前先保留好相关沟通记录。'),
    (('支付超时取消',), '支付超时导致订单取消后，如已扣款，一般会按支付渠道原路退回。到账时间可能受支付渠道处理影响，建议您在订单详情页或支付记录中查看退款进度。'),
    (('超时取消追问', '超时取消'), '如果外卖已经明显超时，建议您先在订单详情页查看实时配送状态。若不想继续等待，可以在订单详情页申请取消或提交配送延迟售后，平台会根据订单状态和超时情况核实处理。'),
    (('接单后取消',), '商家接单后是否还能取消，主要取决于商家是否已经开始制作。如果还未制作，通常可以在订单页面申请取消；如果已经开始制作，可能需要商家确认，退款金额和取消结果以页面展示为准。'),
    (('取餐后取消',), '骑手已取餐后通常不支持直接取消，能否取消或退款需要以订单页面当前状态为准。建议您先联系骑手确认配送情况，并在订单详情页查看是否还有取消入口；如果因特殊原因无法收餐，可以在订单内提交售后申请，平台会结合订单状态核实处理。'),
    (('取消订单',), '如果商家长时间未接单，您可以在订单详情页发起取消申请。系统会根据订单状态处理退款；如果页面无法取消，可以联系平台客服进一步处理。'),
    (('配送异常追问',), '很抱歉让您久等了。请您先在订单详情页查看配送状态，并尝试通过平台内联系功能联系骑手。如果仍联系不上或订单已明显超时，建议立即在订单详情页提交配送异常或未收到餐反馈，平台会核实骑手位置和订单状态。'),
    (('催单',), '骑手位置长时间未更新时，建议您先刷新订单详情页，确认骑手位置和预计送达时间是否持续不变。之后可以通过订单内联系功能联系骑手；如果仍无法联系或长时间没有进展，可以在订单详情页提交配送异常或未收到餐反馈，平台会协助核实处理。'),
    (('未收到餐',), '订单显示已送达但您没有收到餐时，建议先确认门口、前台、取餐柜或指定收餐点是否有餐品，并尝试联系骑手。如果仍未找到，请在订单详情页提交未收到餐反馈，平台会核实骑手送达情况和订单状态。'),
    (('延误补偿',), '下雨等恶劣天气可能会影响配送时效。是否可以申请延误补偿，建议您查看订单页面是否有补偿入口；如果超过承诺送达时间，也可以提交配送延迟反馈，具体结果以页面展示和平台处理为准。'),
    (('地址修改追问',), '如果地址写错且骑手已经到达原地址，建议您立即联系骑手说明新地址，并同步联系平台客服确认能否改送。若新地址较远或超出配送范围，可能无法改送；这种情况下可以咨询平台客服是否需要取消后重新下单，具体结果以订单状态和平台处理为准。'),
    (('餐品撒漏售后',), '很抱歉影响您的用餐。餐品撒漏可以在订单详情页申请售后：请选择餐品问题、包装破损、撒漏或配送异常等对应类型，并上传餐品照片、包装破损、袋内撒漏、骑手送达照片或监控截图等凭证，平台会结合配送过程和凭证核实处理。'),
    (('食品安全投诉',), '需要通过订单售后提交食品安全投诉，平台会结合凭证和订单情况核实处理，但不能在没有凭证和核实结果前承诺赔付。建议您先停止食用，并拍照保留异物、餐品和包装等凭证；是否赔付以平台核实结果为准。'),
    (('少送漏送',), '少送或漏送时，可以在订单内按少送漏送提交售后处理。建议您拍照保留实际收到的餐品和小票，并在订单详情页选择少送或漏送提交售后，平台会根据凭证协助处理。'),
    (('错送餐品',), '送错餐品时，可以在订单详情页提交餐品错误售后申请。请您先拍照保留实际收到的餐品、包装和订单小票，平台会结合凭证和订单情况核实处理。'),
    (('备注未满足',), '很抱歉影响您的用餐体验。备注口味通常由商家制作环节处理，建议您保留餐品照片，并在订单售后中反馈未按备注制作，平台会结合订单信息和凭证协助核实处理。'),
    (('骑手态度投诉',), '很抱歉给您带来不好的体验。您可以在订单详情页选择骑手服务投诉，并描述具体情况，平台会根据投诉内容进行核实处理。'),
    (('商家电话咨询',), '商家电话一般在订单详情页或商家主页的“联系商家”入口查看。建议您优先通过平台内电话或在线联系功能沟通；不同商家展示方式可能不同，具体联系方式以订单页面或商家页面展示为准。'),
    (('联系商家咨询',), '部分问题平台客服可以协助联系商家核实。您也可以优先通过订单详情页的联系商家入口沟通，并尽量保留平台内聊天记录，方便后续核实处理。'),
    (('私下收费风险',), '不可以加微信转运费，也不建议私下转账配送费。配送费应以平台订单结算页为准，任何额外费用都应通过官方渠道确认和处理。请您保留聊天记录、转账要求截图等证据，并在订单内查看费用明细或提交反馈，避免产生资金纠纷。'),
    (('隐私保护咨询',), '平台通常会通过隐私号等方式保护用户和骑手手机号。您可以通过订单页面内的联系功能或平台提供的虚拟号进行沟通，不要在聊天中主动发送完整手机号、验证码或其他敏感信息。'),
    (('验证码诈骗提醒',), '不可以，不需要发送验证码才能退款。不要发送或告知验证码，验证码、密码等属于隐私和敏感信息，请不要向骑手或任何人提供。涉及退款、配送或订单处理，请通过订单页面或官方客服渠道操作，并保留相关沟通记录。'),
    (('优惠券不可用',), '不能直接判断平台会补偿，也不能直接赔一张券。优惠券不能使用通常与使用门槛、有效期、适用品类、适用商家或支付方式限制有关。请您点开优惠券详情或结算页查看不可用原因；如果确认满足条件仍不可用，可以截图后通过订单页或官方客服反馈核实。'),
    (('满减未生效',), '满减活动没有自动减，通常可能是未达到指定金额、未购买指定商品，或不符合指定商家、活动时间等规则。建议您查看活动规则和结算页优惠明细，确认是否满足使用条件。'),
    (('优惠叠加咨询',), '优惠券是否可以和满减一起使用，取决于活动规则。有些优惠可以叠加，有些不可叠加，建议您以结算页展示的最终优惠明细为准。'),
    (('发票开具咨询',), '是否支持开发票取决于商家和订单类型。您可以在订单详情页查看是否有申请发票入口；如果没有入口，建议联系商家或平台客服确认。'),
]

#: Intents whose reply is forced.
FORCED_INTENTS = ('商家拒绝退款', '少送漏送', '未收到餐', '私下收费风险', '退款失败', '配送异常追问', '错送餐品', '食品安全投诉', '餐品撒漏售后', '验证码诈骗提醒', '骑手态度投诉')

#: Replies of the three special cases.
SPECIAL_REPLIES = [
    '骑手说已到但定位仍很远，属于配送状态和骑手定位不一致。请先在订单详情页核对配送状态，并通过平台内联系功能联系骑手确认实际位置；如果仍无法确认或联系不上，立即提交配送异常或未收到餐反馈，平台会结合骑手位置、配送进度和订单状态核实处理。',
    '骑手取餐后一直没收到餐，可以提交未收到餐反馈；能否退款需要以平台核实结果为准。建议您先确认门口、前台、取餐柜或指定收餐点是否有餐品，并尝试联系骑手；如果仍未找到，请在订单详情页提交未收到餐反馈，平台会核实骑手送达情况和订单状态。',
    '付款失败但显示扣款时，先看订单状态和页面展示的失败原因，再在订单支付页、支付记录或原支付渠道查看扣款和退款进度。如果页面没有明确说明，可以通过订单页联系平台客服核实处理；如系统支持重新提交退款申请，再按页面提示重新提交，具体到账以支付渠道和平台核实结果为准。',
]

#: Phrases of a useless reply.
BAD_GENERIC_REPLIES = ('很抱歉，这个问题我来帮您分析一下', '我会先帮您按订单问题来判断', '请您先根据订单问题判断')

#: Endings that say nothing.
GENERIC_TAILS = ('您可以先根据订单页面提示操作，相关结果以页面展示和平台处理为准。', '我理解您现在比较着急，这类问题建议优先在订单内处理，方便平台核实。')

#: Terms of a conclusion.
CONCLUSION_TERMS = ('不可以', '不建议', '可以', '建议', '通常', '一般', '取决于', '需要', '无法', '可能', '是否')

#: Terms of an action.
ACTION_TERMS = ('订单详情页', '订单页面', '退款详情页', '结算页', '优惠券详情', '联系', '提交', '申请', '查看', '上传', '保留', '拍照', '反馈', '投诉')

#: Terms of a caveat.
CAVEAT_TERMS = ('以页面', '以订单', '以平台', '以商家', '以核实', '具体结果', '最终', '可能', '需要商家确认', '支付渠道', '订单状态')

#: What a query asks for.
QUERY_NEED_KEYWORDS = {
    'yes_no_request': ('能不能', '可以吗', '行吗', '合理吗', '能退', '能直接', '发我', '给我'),
    'reason_request': ('为什么', '凭什么'),
    'action_request': ('怎么办', '怎么处理', '现在咋办'),
    'safety_or_privacy_boundary': ('手机号', '联系电话', '验证码', '私下转账', '私下'),
    'refund_dispute': ('没吃上', '没收到', '没拿到', '扣钱', '扣我钱', '扣了钱', '配送费', '没全退', '只退', '少退'),
}

#: Terms of a boundary.
BOUNDARY_TERMS = ('不能', '不可以', '不建议', '无法', '不要', '未开放', '页面没有展示')

#: Action that an intent's answer must have.
REQUIRED_ACTIONS_BY_INTENT = {
    '取消订单': '如果商家一直未接单，您可以在订单详情页发起取消申请；页面无法取消时再联系平台客服处理。',
    '接单后取消': '建议您先在订单详情页查看是否仍有取消入口；如果商家已开始制作，可能需要商家确认，也可以按页面提示提交售后或联系平台客服核实。',
    '配送异常追问': '建议您先在订单详情页查看配送状态，并通过平台内联系功能联系骑手；仍联系不上时提交配送异常反馈。',
    '催单': '建议您先刷新订单详情页并尝试联系骑手；如果位置长时间不更新、联系不上或仍无进展，可以在订单详情页反馈配送异常。',
    '地址修改追问': '建议您先确认骑手是否仍在原地址或是否已继续配送，并立即联系骑手说明新地址；如超出配送范围或无法改送，请联系平台客服协商取消、重新下单或售后处理。',
    '备注未满足': '提交售后时建议您上传餐品照片和订单备注截图，反馈未按备注制作。',
    '未收到餐': '建议您先确认门口、前台、取餐柜或指定收餐点是否有餐品，并尝试联系骑手；如果仍未找到，请在订单详情页提交未收到餐反馈。',
    '餐品撒漏': '请在订单详情页申请售后，并上传包装破损、撒漏情况、餐品照片等凭证。',
    '餐品撒漏售后': '请在订单详情页申请售后，并上传包装破损、撒漏情况、餐品照片等凭证。',
    '隐私保护咨询': '建议您通过平台内联系功能沟通，不要在聊天中主动发送完整手机号、地址或验证码。',
    '商家电话咨询': '建议您优先通过平台内电话或在线联系功能沟通。',
    '联系商家咨询': '平台客服可根据问题类型协助联系商家核实，建议您优先通过订单详情页的联系商家入口沟通并保留平台内聊天记录。',
    '优惠券不可用': '请先点开优惠券详情或结算页查看不可用原因；如果确认满足条件仍不可用，可以截图后通过订单页或官方客服反馈核实。',
    '发票开具咨询': '请先进入订单详情页查看是否有申请发票入口；如果页面没有入口，可以联系商家或平台客服确认。',
    '取餐后取消': '建议您先联系骑手确认配送情况，并在订单详情页查看是否还有取消入口；如果因特殊原因无法收餐，可以在订单内提交售后申请。',
}

#: Caveat that an intent's answer must have.
REQUIRED_CAVEATS_BY_INTENT = {
    '取消订单': '取消结果和退款处理以订单状态、订单详情页展示和平台处理结果为准。',
    '接单后取消': '取消结果和退款金额以订单状态、是否制作、商家确认和订单页面展示为准。',
    '配送异常追问': '平台会结合骑手位置、配送进度和订单状态核实处理。',
    '催单': '骑手位置长时间未更新可能与网络延迟、等待出餐或路况有关，处理结果以订单页面和平台核实为准。',
    '地址修改追问': '新地址能否改送取决于配送范围、骑手位置和订单状态。',
    '备注未满足': '平台会结合订单备注、商家制作情况和凭证核实处理。',
    '未收到餐': '平台会核实骑手送达情况和订单状态，退款或售后结果以平台核实处理为准。',
    '退款金额咨询': '平台会结合订单状态、配送进度、优惠抵扣和凭证核实处理。',
    '餐品撒漏': '平台会结合配送过程和凭证核实处理。',
    '餐品撒漏售后': '平台会结合配送过程和凭证核实处理。',
    '隐私保护咨询': '平台通常会通过隐私号等方式保护用户和骑手手机号，具体展示以平台规则和订单页面为准。',
    '商家电话咨询': '如果页面没有展示电话，说明商家可能未开放电话联系或使用平台虚拟号。',
    '联系商家咨询': '具体能否协助联系和处理结果以订单页面展示及平台核实为准。',
    '发票开具咨询': '是否支持开票以商家、订单类型和订单页面展示为准。',
    '取餐后取消': '取消、退款或售后结果以订单状态和平台核实处理为准。',
}

#: Conclusion of an intent's answer.
REQUIRED_CONCLUSIONS_BY_INTENT = {
    '退款金额咨询': '订单取消后只退一部分，通常与商家是否已制作、配送是否已开始、优惠券抵扣或平台规则有关。',
    '催单': '骑手位置一直停在一个地方，通常可能与等待出餐、网络延迟或路况有关。',
    '配送异常追问': '配送状态、骑手定位或送达情况不一致时，建议优先按配送异常处理。',
    '地址修改追问': '地址写错且骑手已经到原地址时，需要尽快确认骑手当前位置并说明新地址。',
    '备注未满足': '如果备注了不要辣但餐品仍然很辣，可以按未按备注制作申请售后。',
    '未收到餐': '骑手取餐后仍未收到餐时，需要先按未收到餐或配送异常核实处理。',
    '餐品撒漏': '餐品撒漏、汤汁漏出或包装破损时，可以按餐品撒漏售后处理。',
    '餐品撒漏售后': '餐品撒漏、汤汁漏出或包装破损时，可以按餐品撒漏售后处理。',
    '联系商家咨询': '部分问题平台客服可以协助联系商家核实。',
    '接单后取消': '商家已接单或已开始制作后，能否取消及是否全额退款需要以订单状态、是否制作和页面展示为准。',
    '商家电话咨询': '商家电话一般在订单详情页或商家主页的“联系商家”入口查看，有电话时会在该入口展示。',
    '优惠券不可用': '优惠券不能使用通常与使用门槛、有效期、适用品类、适用商家或支付方式限制有关。',
    '发票开具咨询': '发票一般需要在订单详情页查看是否有申请发票入口，是否支持取决于商家和订单类型。',
    '延误补偿': '恶劣天气或配送超时能否补偿需要以承诺送达时间、订单页面补偿入口和平台核实结果为准。',
    '少送漏送': '少送或漏送时，可以在订单内按少送漏送提交售后处理。',
    '骑手态度投诉': '骑手态度问题可以在订单详情页提交骑手服务投诉。',
    '取餐后取消': '骑手取餐后通常不支持直接取消，能否取消或退款需要以订单状态和平台核实结果为准。',
}

#: Texts of the answer steps: conclusion, action and caveat of each.
STEPS = {
    'missing_food_guarantee': (
        '不能直接承诺全额退款，需要先由平台核实骑手送达情况和订单状态。',
        '如果您仍未找到餐品或无法立即取回餐品，请先确认门口、前台、取餐柜或指定收餐点，并在订单详情页提交未收到餐反馈。',
        '退款或售后结果以平台核实处理为准。',
    ),
    'refund_time_guarantee': (
        '不能直接承诺全额退款或具体到账时间，退款需要以订单状态和平台核实结果为准。',
        '建议您先在订单详情页查看退款状态；如已支付，退款通常会按支付渠道原路退回。',
        '到账时间可能受支付渠道处理影响，具体以订单页面和平台处理结果为准。',
    ),
    'refund_amount_guarantee': (
        '不能直接承诺平台全额退款，退款金额需要结合订单状态、配送进度和平台规则核实。',
        '建议您先查看退款详情页的扣除原因；如果认为金额不合理，可以在订单内提交售后复核或申请平台介入。',
        '具体退款结果以退款详情页和平台核实处理为准。',
    ),
    'delay_guarantee': (
        '不能保证超时后都会赔钱，是否补偿需要看承诺送达时间、订单页面入口和平台核实结果。',
        '如果超过承诺送达时间，您可以在订单详情页查看是否有补偿入口，或提交配送延迟反馈。',
        '具体补偿或处理结果以页面展示和平台核实为准。',
    ),
    'missing_item_guarantee': (
        '不能直接承诺由商家立即补送，少送漏送需要先提交售后并由平台核实。',
        '建议您拍照保留实际收到的餐品和小票，并在订单详情页选择少送或漏送提交售后。',
        '平台会根据凭证协助处理，具体补送、退款或其他方案以核实结果为准。',
    ),
    'food_safety_guarantee': (
        '需要通过订单售后提交食品安全投诉，平台会结合凭证和订单情况核实处理，但不能在没有凭证和核实结果前承诺赔付。',
        '建议您先停止食用；如果仍能补充证据，请尽量拍照保留餐品、包装、异物照片或就医记录。',
        '是否赔付以平台核实处理结果为准。',
    ),
    'rider_guarantee': (
        '不能保证处罚骑手或赔偿，平台需要先根据投诉内容核实处理。',
        '您可以在订单详情页选择骑手服务投诉，并描述具体情况、时间和沟通过程。',
        '具体处理结果以平台核实为准。',
    ),
    'cancel_guarantee': (
        '不能保证商家接单后取消一定不扣钱，能否取消和退款金额需要以订单状态、是否制作和页面显示为准。',
        '建议您先在订单详情页查看是否仍有取消入口；如果商家已开始制作，可以按页面提示提交售后或联系平台客服核实。',
        '取消结果和退款金额以订单状态、商家确认和订单页面显示为准。',
    ),
    'refund_not_eaten': (
        '没吃上但仍被扣款或只退部分金额，通常与商家是否已制作、配送是否已开始、优惠券抵扣或平台规则有关。',
        '建议您先在退款详情页查看扣除原因；如您认为扣款不合理，可以在订单内提交售后复核或申请平台介入。',
        '平台会结合订单状态和凭证核实处理。',
    ),
    'delivery_fee_fairness': (
        '不能直接判断扣配送费是否合理，需要先看退款详情页的扣除原因和平台核实结果。',
        '建议您先查看退款详情页，如页面原因不清楚，可以在订单内提交售后复核。',
        '平台会结合配送进度、订单状态和凭证核实处理。',
    ),
    'delivery_fee': (
        '餐没拿到但仍被扣配送费或只退部分金额时，需要以退款详情页的扣除原因和平台核实结果为准。',
        '建议您先查看退款详情页，如页面原因不清楚，可以在订单内提交售后复核。',
        '平台会结合配送进度、订单状态和凭证核实处理。',
    ),
    'coupon_compensation': (
        '不能直接判断平台会补偿，也不能直接赔一张券；优惠券或满减未生效需要先核实使用条件和结算页原因。',
        '请先点开优惠券详情或结算页查看使用门槛、有效期、适用品类、适用商家和支付方式限制；确认满足条件仍不可用时，可以截图后通过订单页或官方客服反馈。',
        '是否补偿或调整以平台核实处理结果为准。',
    ),
    'invoice': (
        '发票可以先在订单详情页查看申请发票入口，是否支持取决于商家和订单类型。',
        '如果页面没有入口，可以联系商家或平台客服确认。',
        '是否支持开票以商家、订单类型和订单页面展示为准。',
    ),
    'remark_allergy': (
        '如果已备注过敏但餐品仍放入相关食材，建议先停止食用，并按未按备注制作或餐品问题提交售后。',
        '建议您上传餐品照片、订单备注截图和相关沟通记录，说明过敏备注未被满足。',
        '平台会结合订单备注、餐品情况和凭证核实处理。',
    ),
    'remark_scallion': (
        '如果已备注不要葱但餐品仍放了葱，可以按未按备注制作提交售后。',
        '建议您上传餐品照片、订单备注截图和相关沟通记录，反馈商家未按备注制作。',
        '平台会结合订单备注、餐品情况和凭证核实处理。',
    ),
    'remark_coriander': (
        '如果已备注不要香菜但餐品仍放了香菜，可以按未按备注制作提交售后。',
        '建议您上传餐品照片、订单备注截图和相关沟通记录，反馈商家未按备注制作。',
        '平台会结合订单备注、餐品情况和凭证核实处理。',
    ),
    'remark_diet': (
        '如果已写明忌口或过敏备注但商家未按备注制作，可以按未按备注制作或餐品问题提交售后。',
        '建议您上传餐品照片、订单备注截图和相关沟通记录。',
        '平台会结合订单备注、餐品情况和凭证核实处理。',
    ),
    'contact_for_refund': (
        '平台客服不能绕过平台直接联系商家要求退款，但可以根据问题类型协助联系商家核实。',
        '建议您优先通过订单详情页的联系商家入口沟通，并保留平台内聊天记录；需要客服协助时可在订单内提交问题。',
        '具体能否协助联系和处理结果以订单页面展示及平台核实为准。',
    ),
    'contact_by_call': (
        '平台客服不能绕过平台直接代打给店家，但可以根据问题类型协助联系商家核实。',
        '建议您优先通过订单详情页的联系商家入口沟通，并保留平台内聊天记录；需要客服协助时可在订单内提交问题。',
        '具体能否协助联系和处理结果以订单页面展示及平台核实为准。',
    ),
    'rider_unreachable': (
        '骑手联系不上时，建议先按配送异常处理。',
        '请先在订单详情页查看配送状态，并通过平台内联系功能再次联系骑手；如果仍联系不上或订单已明显超时，请在订单详情页提交配送异常反馈。',
        '平台会结合骑手位置、配送进度和订单状态核实处理。',
    ),
    'rider_arrived_elsewhere': (
        '骑手说已到但定位仍很远，属于配送状态和骑手定位不一致，建议先按配送异常处理。',
        '请先在订单详情页核对配送状态，并通过平台内联系功能联系骑手确认实际位置；如果仍无法确认或联系不上，立即提交配送异常或未收到餐反馈。',
        '平台会结合骑手位置、配送进度和订单状态核实处理。',
    ),
    'missing_food_refund': (
        '骑手取餐后一直没收到餐，可以提交未收到餐反馈；能否退款需要以平台核实结果为准。',
        '建议您先确认门口、前台、取餐柜或指定收餐点是否有餐品，并尝试联系骑手；如果仍未找到，请在订单详情页提交未收到餐反馈。',
        '平台会核实骑手送达情况和订单状态，退款或售后结果以平台核实处理为准。',
    ),
    'merchant_sees_phone': (
        '商家一般不应直接看到您的真实手机号，平台通常会通过隐私号等方式保护联系方式。',
        '建议您通过订单页面或平台内联系功能沟通，不要在聊天中主动发送完整手机号、地址或验证码。',
        '具体号码展示方式以平台规则和订单页面为准。',
    ),
    'merchant_phone': (
        '不能直接提供页面未展示的店家手机号。',
        '您可以在订单详情页或商家主页查看“联系商家”入口，并优先通过平台内电话或在线联系功能沟通。',
        '如果页面没有展示电话，说明商家可能未开放电话联系或使用平台虚拟号，具体以页面展示为准。',
    ),
}

#: The conclusion where the platform's own service and a phone number are asked about.
PLATFORM_PHONE_CONCLUSION = '平台客服处理订单时也应遵守平台隐私保护规则，您不需要主动提供完整手机号。'

#: Terms of a promise.
RISKY_PROMISE_TERMS = ['一定', '补偿', '保证', '必赔', '百分百']

#: Questions of a review.
REVIEW_QUESTIONS = ['回复是否直接回答了用户问题？', '回复中的关键说法是否能被参考资料支撑？', '回复是否给出了安全、可执行的下一步？']

#: Terms beside which a forbidden word is harmless.
SAFE_FORBIDDEN_CONTEXT_TERMS = ['不要', '不能', '不支持', '无法', '请勿', '避免', '不建议', '不要提供', '不要私下', '不建议私下', '不支持直接取消', '不能直接取消', '无法直接取消', '不建议直接取消']

#: Fields of a judge's answer.
JUDGE_REQUIRED_FIELDS = ['direct_answer', 'grounded', 'useful', 'risk_notes', 'reason']

#: Kinds of a judge's failure.
JUDGE_FAILURE_TYPES = ['empty_response', 'not_json', 'missing_field', 'invalid_enum', 'empty_reason', 'other']

#: Fields of an evaluation case.
CASE_FIELDS = ('case_type', 'expected_evidence_keywords', 'expected_intent', 'forbidden_keywords', 'id', 'notes', 'query', 'scenario')

#: Types of an evaluation case.
CASE_TYPES = ('baseline', 'boundary_promise', 'inducement', 'long_context', 'multi_intent', 'oral')

#: Reasons that a calibration appends, in the order of the rules.
CALIBRATION_REASONS = [
    'Calibrated: reference documents do not provide a fixed refund time, and the reply uses the available channel/progress evidence.',
    'Calibrated: safety/privacy answer is conservative, directly actionable, and supported by the matched safety intent.',
    'Calibrated: merchant phone reply gives the supported order/detail or merchant-page contact entry and explains the no-phone fallback.',
    'Calibrated: refund amount reply avoids unsupported fairness claims and uses refund-detail/review evidence.',
    'Calibrated: invoice reply gives the supported order-detail invoice-entry path.',
    'Calibrated: coupon reply refuses unsupported compensation and gives the supported coupon-detail / checkout / screenshot feedback path.',
    'Calibrated: delay-compensation reply refuses an unsupported payout guarantee and gives the supported compensation-entry / delay-feedback path.',
    'Calibrated: contact-assistance reply gives a safe no-private-call boundary and the supported platform contact path.',
    'Calibrated: cancel-after-acceptance reply refuses an unsupported no-deduction guarantee and uses order-status/page-display evidence.',
    'Calibrated: picked-up cancellation reply gives the supported contact-rider / cancel-entry / after-sales path.',
    'Calibrated: missing-food reply refuses an unsupported full-refund guarantee and gives the supported order-detail feedback path.',
    'Calibrated: missing-item reply refuses an immediate-reship promise and gives the supported photo / receipt / after-sales path.',
    'Calibrated: missing-item reply gives the supported photo / receipt / after-sales path.',
    'Calibrated: wrong-item reply gives the supported photo / packaging / order-detail after-sales path.',
    'Calibrated: rider-complaint reply refuses unsupported punishment or compensation and gives the supported complaint path.',
    'Calibrated: food-safety reply refuses unsupported payout without evidence and gives the supported evidence / complaint path.',
    'Calibrated: food-safety reply gives the supported order-after-sales complaint and platform verification path.',
]

#: What to do about a failure.
ISSUE_ACTIONS = [
    ('retrieval_failure', '改召回、重排、query rewrite 或意图规则'),
    ('evidence_insufficient', '补知识库证据，别先改 prompt'),
    ('generation_not_using_evidence', '改生成 prompt、answer plan 或 reply rules'),
    ('judge', '修 judge 输出或判分标准'),
    ('judge_or_other', '人工复核，先别盲改链路'),
]

#: What to do about a failure of generation.
GENERATION_ACTIONS = [
    ('judge_too_strict', '先复核 judge 标尺或 judge prompt'),
    ('reply_not_direct_enough', '优化回答开头，让结论更直接'),
    ('reply_missing_required_step', '补 answer plan 的必要步骤约束'),
    ('evidence_wording_mismatch', '补证据表述或放宽 judge 对同义表达的要求'),
]

#: Labels of a question.
EXPRESSION_RULES = {
    'standard': ['怎么', '为什么', '吗', '能不能', '可以'],
    'emotional': ['凭什么', '别让我', '不想', '太', '恶心', '生气', '差', '投诉', '不合理'],
    'boundary': ['扣钱', '没全退', '只退', '手机号', '联系电话', '验证码', '私下', '赔', '忌口', '香菜'],
    'followup': ['多轮', '继续追问', '如果对方一直不处理', '现在我应该'],
    'terse': ['退款', '发票', '催单', '不到账'],
}

#: Labels of an answer.
ANSWER_RULES = {
    'cause': ['因为', '可能', '取决于', '有关', '根据'],
    'action': ['建议', '可以', '请', '查看', '提交', '联系', '申请', '上传'],
    'caution': ['以页面', '以平台', '以订单', '为准', '核实', '不要', '不建议', '无法', '是否'],
    'evidence': ['照片', '截图', '凭证', '记录', '小票', '包装'],
}

#: Intents that are easily confused.
CONFUSION_PAIRS = [('退款金额咨询', '银行卡扣款异常'), ('退款金额咨询', '未收到餐'), ('商家电话咨询', '联系商家咨询'), ('催单', '配送异常追问'), ('备注未满足', '备注咨询')]

#: System turn of a training record.
SYSTEM_PROMPT = '你是外卖平台中文客服。回答要礼貌、准确、简洁，先安抚用户，再说明原因，最后给出可执行的下一步。不要编造平台规则；遇到支付、隐私、食品安全、站外交易等高风险问题时要提醒用户保留证据并通过官方渠道处理。'

#: Openings of a question.
QUESTION_PREFIXES = ['您好，', '客服你好，', '请问一下，', '麻烦问下，', '我想咨询一下，']

#: Endings of a question.
QUESTION_SUFFIXES = ['这个要怎么处理？', '现在我该怎么办？', '可以帮我看一下吗？', '这种情况平台怎么处理？', '能不能给我一个解决办法？']

#: Replacements of the colloquial style, in order.
COLLOQUIAL_REPLACEMENTS = [('我的外卖', '我这单外卖'), ('怎么还没到', '咋还没到'), ('可以', '能不能'), ('怎么办', '咋办'), ('为什么', '为啥'), ('订单', '这单'), ('骑手', '配送员'), ('商家', '店家'), ('退款', '退钱')]

#: Further questions.
FOLLOW_UPS = ['那现在我应该先做什么？', '如果对方一直不处理怎么办？', '需要我上传什么凭证吗？', '我还能继续申请平台介入吗？', '这个会影响退款吗？']

#: Sentence after an answer by sentiment.
BRIDGE_SENTENCES = {
    'negative': '我理解您现在比较着急，这类问题建议优先在订单内处理，方便平台核实。',
    'neutral': '您可以先根据订单页面提示操作，相关结果以页面展示和平台处理为准。',
    'positive': '感谢您的反馈，您也可以在订单评价中继续补充体验，帮助平台和商家改进服务。',
}

#: Records of the training set.
TARGET_SIZE = 500

#: Fields of an answer plan.
PLAN_FIELDS = ['user_intent', 'answer_type', 'direct_answer_brief', 'key_evidence', 'action_suggestion', 'needs_caution', 'caution_reason']

#: Reason of caution where a plan has none.
PLAN_CAUTION = '具体处理结果可能受支付渠道、订单状态或平台审核影响'

#: Last lines of the plan prompt.
PLAN_PROMPT_TAIL = [
    '',
    '请输出 JSON，字段要求：',
    '1. "user_intent": 用一句话概括用户真正想解决的问题',
    '2. "answer_type": 用简短标签概括回答类型，例如 refund_progress / aftersale / safety_warning',
    '3. "direct_answer_brief": 只写一句简短核心答案，不要展开，尽量不超过 25 个字',
    '4. "key_evidence": 从参考资料提取 1-3 条关键依据，必须是字符串列表',
    '5. "action_suggestion": 只写一句简短下一步动作，尽量不超过 18 个字',
    '6. "needs_caution": true 或 false',
    '7. "caution_reason": 如果 needs_caution=true，说明为什么要保守表达；否则写空字符串',
    '',
    '只输出这样的 JSON：',
    '{',
    '  "user_intent": "...",',
    '  "answer_type": "...",',
    '  "direct_answer_brief": "...",',
    '  "key_evidence": ["...", "..."],',
    '  "action_suggestion": "...",',
    '  "needs_caution": true,',
    '  "caution_reason": "..."',
    '}',
]

#: First lines of the plan prompt; the query follows the one before the last two.
PLAN_PROMPT_HEAD = [
    '你是外卖平台客服回答规划助手。',
    '请只根据用户问题和参考资料，先输出一个更结构化的回答计划 JSON。',
    '不要输出最终客服话术，不要输出 Markdown，不要补充额外解释。',
    'direct_answer_brief 必须简短，只写核心结论，尽量不超过 25 个字，不要写成长段客服回复。',
    "action_suggestion 必须简短，只写下一步动作，尽量不超过 18 个字，不要展开解释，不要写'相关结果以页面展示为准'这类补充说明。",
    '',
    '用户问题：',
    '',
    '参考资料：',
]

#: First lines of the prompt; the query stands before the last two.
PROMPT_HEAD = ['你是外卖平台中文客服。请只根据参考资料，直接输出给用户的最终客服回复。', '不要解释你的回答思路，不要复述任务要求，不要输出无关套话。', '如果参考资料不足以支持确定结论，请明确说明以订单页面或官方客服核实结果为准。', '', '用户问题：', '', '参考资料：']

#: Last lines of the prompt.
PROMPT_TAIL = [
    '',
    '回复要求：',
    '1. 使用中文，语气礼貌、简洁。',
    '2. 必须优先使用第 1 条最相关参考资料；补充参考资料只能用于补充流程，不得覆盖第 1 条的意图结论。',
    '3. 第一句必须直接回答用户核心问题，不能先说“我理解/建议您先/可能需要”等铺垫话。',
    '4. 回答必须覆盖最相关参考资料里的关键操作词、入口、限制条件和凭证要求；不要只写笼统的“以页面为准”。',
    '5. 不要编造平台规则，不要承诺一定赔付、一定退款或一定处理成功。',
    '6. 用户问“可以吗/能不能/可不可以”时，第一句先回答“可以/不建议/需要以订单状态为准”，再说明依据或步骤。',
    '7. 用户问“在哪里看”时，第一句必须给具体入口路径，例如订单详情页、商家主页、联系商家入口、售后入口。',
    '8. 用户问“怎么办/怎么处理”时，按“先确认状态 -> 执行页面操作或联系对象 -> 无效时提交反馈/售后/平台客服”的顺序回答。',
    '9. 用户问“多久到账/多久退回”时，第一句先回答到账时间受支付渠道影响，再说明原路退回、可能延迟和查看退款进度的入口；不确定时再加以订单页为准。',
    '10. 如果有条件限制，放在最后说明，并表达为以订单页或平台处理结果为准。',
    '',
    '最终客服回复：',
]

#: Text before the question, before the documents, before the reply, and after it.
JUDGE_PROMPT_PARTS = [
    'You are a strict evaluation judge for a customer service reply.\nOutput JSON only. No markdown. No explanation.\n\nScore each field with one of these exact values: yes, partial, no.\n\nRules:\n- direct_answer: yes if the reply directly answers the current user question.\n- grounded: yes if the reply is mainly supported by the reference documents.\n- useful: yes if the reply is actually helpful to the user.\n- If the reference documents do not provide a concrete number, time, or amount,\n  do not mark the reply as no only because it avoids inventing one.\n  A reply can be direct and useful when it explains the known dependency,\n  tells the user where to check progress, or says the final result depends on\n  the order page / platform verification.\n\nInput:\nQuestion:\n',
    '\n\nReference documents:\n',
    '\n\nReply:\n',
    '\n\nReturn exactly this JSON shape:\n{\n  "direct_answer": "yes|partial|no",\n  "grounded": "yes|partial|no",\n  "useful": "yes|partial|no",\n  "risk_notes": "short risk note or empty string",\n  "reason": "short reason"\n}',
]

#: Reply where generation fails.
FALLBACK_REPLY = '抱歉，这个问题我暂时无法稳定判断。建议您先在订单页面查看最新状态，如仍有疑问，请通过官方客服渠道进一步核实处理。'

#: Prompt before the query where nothing is retrieved.
FALLBACK_PROMPT = '没有检索到完全匹配的知识库材料。请只基于外卖客服通用处理原则回答，不要编造具体平台政策；如果需要平台核实，请建议用户在订单页或官方客服渠道处理。\n\n用户问题：'
