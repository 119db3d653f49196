"""DuckDB SQL for the registered queries, over the raw tables."""

from __future__ import annotations

VIEWS = {
    "governorate": """
select r_regionkey as id, r_name as name_ar, upper(substr(r_name, 1, 3)) as code, r_regionkey as sort_order from region""",
    "area": """
select n_nationkey as id, n_name as name_ar, n_regionkey as governorate_id from nation""",
    "app_user": """
select c_custkey as id, concat('+96470', lpad(cast(c_custkey as string), 8, '0')) as phone,
       case when c_custkey % 10 = 0 then null else c_name end as name, 'CUSTOMER' as role,
       c_custkey % 50 = 7 as is_blocked from customer
union all
select 1000000 + s_suppkey, concat('+96471', lpad(cast(s_suppkey as string), 8, '0')), s_name, 'VENDOR', false from supplier""",
    "vendor": """
select s_suppkey as id, 1000000 + s_suppkey as user_id, s_name as store_name,
       case s_suppkey % 10 when 7 then 'PENDING' when 8 then 'SUSPENDED' when 9 then 'REJECTED' else 'APPROVED' end as status,
       cast(case when s_suppkey % 25 = 0 then 0.0000 when s_suppkey % 5 = 0 then 0.0700 else null end as decimal(5,4)) as commission_rate,
       case when s_suppkey % 20 = 3 then null else n_regionkey end as governorate_id
from supplier left join nation on s_nationkey = n_nationkey""",
    "category": """
select distinct p_type as id, p_type as name_ar, cast(null as string) as parent_id, true as is_active from part
union all
select distinct concat(p_type, '/', p_brand), p_brand, p_type, p_brand <> 'Brand#13' from part""",
    "product": """
select p_partkey as id, p_partkey % (select count(*) from supplier) as vendor_id,
       concat(p_type, '/', p_brand) as category_id, p_name as title, lower(p_name) as title_norm,
       cast(p_retailprice as decimal(12,2)) as base_price,
       case p_partkey % 10 when 0 then 'DRAFT' when 1 then 'PENDING_REVIEW' when 2 then 'REJECTED' when 3 then 'ARCHIVED' else 'ACTIVE' end as status
from part""",
    "product_variant": """
select p_partkey * 10 + k as id, p_partkey as product_id,
       cast(p_retailprice as decimal(12,2)) + k * 10 as price,
       cast(p_size * 10 + k as int) as stock, cast((p_size * 3 + k * 7) % 40 as int) as reserved_stock,
       not (k = 2 and p_partkey % 4 = 0) as is_active
from part cross join (select 0 as k union all select 1 union all select 2) v where k <= p_size % 3""",
    "product_image": """
select p_partkey * 10 + k as id, p_partkey as product_id, cast(k as int) as sort_order, concat('/img/', p_partkey, '/', k, '.jpg') as url from part, range(3) t(k) where k < p_size % 4""",
    "order_item": """
select l_orderkey as checkout_id, l_partkey % (select count(*) from supplier) as vendor_id,
       l_partkey as product_id, l_partkey * 10 as variant_id, cast(l_quantity as int) as quantity,
       cast(l_extendedprice as decimal(12,2)) as line_total, l_shipdate from lineitem""",
    "vendor_order": """
select i.checkout_id, i.vendor_id, o.o_custkey as customer_id, o.o_orderdate as placed_at,
       case o.o_orderstatus
         when 'O' then case o.o_orderkey % 4 when 0 then 'PENDING' when 1 then 'CONFIRMED' when 2 then 'PREPARING' else 'SHIPPED' end
         when 'F' then case o.o_orderkey % 2 when 0 then 'DELIVERED' else 'COMPLETED' end
         else case o.o_orderkey % 3 when 0 then 'CANCELLED' when 1 then 'RETURNED' else 'COMPLETED' end end as status,
       sum(i.line_total) as subtotal, cast(5000 as decimal(12,2)) as delivery_fee, count(*) as item_count
from order_item i join orders o on o.o_orderkey = i.checkout_id
group by i.checkout_id, i.vendor_id, o.o_custkey, o.o_orderdate, o.o_orderstatus, o.o_orderkey""",
    "commission": """
select vo.checkout_id, vo.vendor_id, coalesce(v.commission_rate, cast(0.1000 as decimal(5,4))) as rate,
       cast(floor(vo.subtotal * coalesce(v.commission_rate, cast(0.1000 as decimal(5,4))) + cast(0.5 as decimal(2,1))) as decimal(12,2)) as amount,
       case when vo.checkout_id % 3 = 0 then vo.vendor_id * 1000 else null end as payout_id
from vendor_order vo join vendor v on v.id = vo.vendor_id""",
    "review": """
select event_id as id, user_id, event_id % (select count(*) from part) as product_id,
       cast(1 + event_id % 5 as int) as rating,
       case when event_id % 7 = 0 then 'PENDING' else 'PUBLISHED' end as status, ts as created_at
from events where event_type = 'purchase'""",
    "favorite_toggle": """
select user_id, event_id % 50 as product_id, ts from events where event_type = 'view'""",
    "notification": """
select event_id as id, user_id, 'order.status_changed' as type, props as data,
       case when value < 50 then ts else null end as read_at, ts as created_at from events where event_type = 'click'""",
    "otp_code": """
select event_id as id, user_id as phone_key, ts as created_at from events where event_type = 'signup'""",
    "audit_log": """
select event_id as id, user_id as actor_id, 'event.error' as action, ts as created_at from events where event_type = 'error'""",
}

DONE = "('DELIVERED', 'COMPLETED')"

# Shared steps that several queries start from, beside the views.
#: Inputs by kind: their rows, and the rules in order.
INPUTS = {
    "otp": ("select id, case when id % 13 = 0 then substr(phone, 1, 9) else phone end as phone, substr(concat(' ', id * 977, ' '), 1, 12) as code, case when id % 17 = 0 then 'other' else 'login' end as purpose from app_user",
        {"phone": "regexp_full_match(phone, '[+]9647[0-9]{9}')", "code": "regexp_full_match(trim(code), '[0-9]{4,8}')", "purpose": "purpose in ('login', 'verify')"}),
    "profile": ("select id, name, case id % 3 when 0 then concat('u', id, '@example.com') when 1 then concat('u', id, '@x') end as email from app_user",
        {"name": "length(trim(name)) between 2 and 60", "email": "email is null or regexp_full_match(email, '[a-z0-9]+@[a-z]+[.]com')"}),
    "address": ("select u.id, name as full_name, phone, repeat('x', u.id % 205) as line, case when u.id % 19 <> 0 then c_nationkey end as area_id, case when u.id % 23 <> 0 then c_nationkey % 5 end as governorate_id from app_user u join customer on c_custkey = u.id where role = 'CUSTOMER'",
        {"full_name": "length(trim(full_name)) between 2 and 60", "phone": "regexp_full_match(phone, '[+]9647[0-9]{9}')", "line": "length(line) between 3 and 200", "area": "area_id is not null", "governorate": "governorate_id is not null"}),
    "vendor": ("select id, store_name, id * 37 % 600 as described, governorate_id, id % 3 as logo from vendor",
        {"store_name": "length(trim(store_name)) between 2 and 80", "description": "described <= 500", "governorate": "governorate_id is not null", "logo": "logo <> 2", "payout_account": "true"}),
    "decision": ("select id from vendor", {"decision": "id % 4 <> 3", "note": "id * 7 % 310 <= 300"}),
    "status": ("select o_orderkey as id from orders", {"target": "o_orderkey % 8 in (1, 2, 3, 4, 6)", "note": "true"}),
    "category": ("select id, name_ar from category", {"name": "length(name_ar) between 2 and 60", "icon": "length(id) * 3 <= 40", "sort_order": "length(id) >= 8"}),
    "platform": ("select event_id as id, value from events where event_type = 'error'", {"commission_rate": "value / 80 between 0 and 1", "delivery_fee": "floor(value * 1500) between 0 and 100000"}),
    "product": ("select id, title, base_price from product", {"title": "length(trim(title)) between 3 and 120", "category": "true", "price": "base_price between 250 and 100000000 and base_price % 1 = 0", "images": "id % 10 <= 8", "image": "id % 11 <> 0 or id % 10 = 0", "variants": "id % 29 <> 0"}),
    "variant": ("select id, price, stock from product_variant", {"price": "price between 250 and 100000000 and price % 1 = 0", "stock": "stock - case when id % 31 = 0 then 1000 else 0 end between 0 and 1000000", "sku": "id % 70 <= 60"}),
    "cart": ("select l_orderkey * 8 + l_linenumber as id, l_quantity * 2 as quantity, row_number() over () as r from lineitem", {"quantity": "quantity between 1 and 99"}),
    "order": ("select o_orderkey as id from orders", {"address": "o_orderkey % 41 <> 0", "items": "o_orderkey % 6 >= 1", "note": "o_orderkey % 320 <= 300"}),
    "review": ("select id, rating from review", {"rating": "rating + case when id % 9 = 0 then 1 else 0 end between 1 and 5", "comment": "id % 520 <= 500"}),
    "list": ("select event_id as id, props, value from events where event_type = 'view'", {"limit": "event_id % 55 between 1 and 50", "phrase": "length(props) <= 80", "min_price": "value - 5 >= 0 and (value - 5) % 1 = 0", "sort": "event_id % 4 <> 3"}),
}


def _input_rules() -> str:
    """A row for each input and rule; inputs that repeat an id have rows of their own by r."""
    parts = []
    for kind, (rows, holds) in INPUTS.items():
        listed = ", ".join(f"{{'rule': '{kind}.{name}', 'n': {n}, 'ok': coalesce({rule.replace('o_orderkey', 'id').replace('event_id', 'id')}, false)}}" for n, (name, rule) in enumerate(holds.items()))
        parts.append(f"select '{kind}' as kind, id::varchar as id, {'r' if kind == 'cart' else '0'} as r, unnest([{listed}], recursive := true) from ({rows})")
    return " union all ".join(parts)


STEPS = {
    "sold": f"""
select i.product_id, cast(sum(i.quantity) as bigint) as sold_count from order_item i
join vendor_order o on o.checkout_id = i.checkout_id and o.vendor_id = i.vendor_id where o.status in {DONE} group by 1""",
    "listed": """
select p.*, v.store_name, v.governorate_id from product p join vendor v on v.id = p.vendor_id where p.status = 'ACTIVE' and v.status = 'APPROVED'""",
    "product_rating": """
select product_id, cast(floor((200 * sum(rating) + count(*)) / (2 * count(*))) as bigint) as hundredths, count(*) as rating_count
from review where status = 'PUBLISHED' group by 1""",
    "vendor_rating": """
select p.vendor_id, cast(floor((2 * sum(r.hundredths) + count(*)) / (2 * count(*))) as bigint) as hundredths, cast(sum(r.rating_count) as bigint) as rating_count
from product_rating r join product p on p.id = r.product_id group by 1""",
    "full_commission": """
select c.*, o.subtotal, o.delivery_fee, o.status, o.placed_at from commission c join vendor_order o on o.checkout_id = c.checkout_id and o.vendor_id = c.vendor_id""",
    "edge": """
select * from (values ('PENDING', 'CONFIRMED', 'VENDOR'), ('PENDING', 'CANCELLED', 'CUSTOMER'), ('PENDING', 'CANCELLED', 'VENDOR'), ('PENDING', 'CANCELLED', 'SYSTEM'), ('CONFIRMED', 'PREPARING', 'VENDOR'),
  ('CONFIRMED', 'CANCELLED', 'VENDOR'), ('PREPARING', 'SHIPPED', 'VENDOR'), ('PREPARING', 'CANCELLED', 'VENDOR'), ('SHIPPED', 'DELIVERED', 'VENDOR'), ('SHIPPED', 'DELIVERED', 'SYSTEM'), ('SHIPPED', 'RETURNED', 'CUSTOMER'),
  ('SHIPPED', 'RETURNED', 'VENDOR'), ('DELIVERED', 'COMPLETED', 'CUSTOMER'), ('DELIVERED', 'COMPLETED', 'SYSTEM'), ('DELIVERED', 'RETURNED', 'CUSTOMER')) e(old, new, actor)""",
    "address": """
select c_custkey * 2 + k as id, c_custkey as user_id, (c_nationkey + k) % 25 as area_id, (k = 0) = (c_custkey % 3 <> 0) as is_default
from customer cross join (select 0 as k union all select 1) t""",
    "local_listed": """
select governorate_id, id, cast(row_number() over (partition by governorate_id order by id desc) as int) as place from listed where governorate_id is not null""",
    "cart": """
select l_orderkey as checkout_id, l_linenumber as line, l_partkey as product_id, cast(least(l_quantity, 9) as int) as quantity, o_custkey as customer_id, o_orderdate as placed_at,
  case when l_partkey % 5 = 0 then null when l_partkey % 7 = 3 then l_partkey * 10 + 2 else l_partkey * 10 end as asked from lineitem join orders on o_orderkey = l_orderkey""",
    "resolved": """
select c.*, x.id as variant_id, x.price as unit_price, greatest(0, x.stock - x.reserved_stock) as available, p.vendor_id, p.title, v.user_id as vendor_user_id, coalesce(v.commission_rate, cast(0.1000 as decimal(5,4))) as rate,
  case when x.id is null then 'variant' when p.status <> 'ACTIVE' or v.status <> 'APPROVED' then 'unavailable' end as reason
from cart c join product p on p.id = c.product_id join vendor v on v.id = p.vendor_id
left join product_variant x on x.product_id = c.product_id and x.is_active and (x.id = c.asked or (c.asked is null and (select count(*) from product_variant y where y.product_id = c.product_id and y.is_active) = 1))""",
    "short_cart": """
select distinct checkout_id from (select checkout_id, variant_id, sum(quantity) as need, any_value(available) as available from resolved where variant_id is not null group by 1, 2) where need > available""",
    "verdict": """
select checkout_id, coalesce(arg_min(reason, (line, reason)) filter (where reason is not null), case when checkout_id in (select checkout_id from short_cart) then 'stock' else 'ok' end) as verdict, count(*) as lines from resolved group by 1""",
    "accepted": """
select r.* from resolved r join verdict d on d.checkout_id = r.checkout_id where d.verdict = 'ok'""",
    "placed_order": """
select checkout_id, vendor_id, any_value(customer_id) as customer_id, any_value(placed_at) as placed_at, any_value(vendor_user_id) as vendor_user_id, any_value(rate) as rate, min(line) as first_line,
  cast(sum(unit_price * quantity) as decimal(12,2)) as subtotal, count(*) as items from accepted group by 1, 2""",
    "numbered_order": """
select *, row_number() over (order by placed_at, checkout_id, first_line, vendor_id) + (select count(*) from vendor_order) as serial, cast(row_number() over (partition by checkout_id order by first_line, vendor_id) as int) as place from placed_order""",
    "asked_list": """
select id as product_id, case when id % 4 <> 0 then list_transform(range(id % 10), lambda k: concat(case when id % 5 = 0 then 'ftp://x/' when id % 3 = 0 then 'https://cdn.example/' else '/img/' end, id, '/', k, '.jpg')) end as images,
  case when id % 4 <> 0 and id % 10 > 8 then 'too_many' when id % 4 <> 0 and id % 5 = 0 and id % 10 > 0 then 'invalid' else 'ok' end as verdict from product where id % 7 = 3""",
    "new_image": """
select product_id, unnest(images) as url, cast(generate_subscripts(images, 1) - 1 as int) as sort_order from asked_list where verdict = 'ok'""",
    "request": """
select o.*, ['PENDING', 'CONFIRMED', 'PREPARING', 'SHIPPED', 'DELIVERED', 'COMPLETED', 'CANCELLED', 'RETURNED'][(checkout_id + vendor_id) % 8 + 1] as target, ['CUSTOMER', 'VENDOR', 'ADMIN', 'SYSTEM'][checkout_id % 4 + 1] as actor,
  concat('note ', checkout_id + vendor_id) as note from vendor_order o""",
    "judged_request": """
select r.*, case actor when 'CUSTOMER' then customer_id::varchar when 'VENDOR' then (vendor_id + 1000000)::varchar else lower(actor) end as actor_id,
  case when status = target then 'same' when status in ('COMPLETED', 'CANCELLED', 'RETURNED') then 'terminal' when not exists (select 1 from edge e where e.old = status and e.new = target) then 'no_edge'
  when actor <> 'ADMIN' and not exists (select 1 from edge e where e.old = status and e.new = target and e.actor = r.actor) then 'role' else 'ok' end as verdict from request r""",
    "judged_call": """
select c.*, case when procedure = 'update' and target in ('PENDING', 'COMPLETED', 'RETURNED') or procedure = 'force' and target = 'PENDING' then 'invalid' when procedure <> 'force' and key % 6 = 0 then 'not_found'
  when status = target then 'same' when status in ('COMPLETED', 'CANCELLED', 'RETURNED') then 'terminal' when not exists (select 1 from edge e where e.old = status and e.new = target) then 'no_edge'
  when procedure <> 'force' and not exists (select 1 from edge e where e.old = status and e.new = target and e.actor = case procedure when 'update' then 'VENDOR' else 'CUSTOMER' end) then 'role' else 'ok' end as verdict
from (select o.*, case when procedure = 'cancel' then 'CANCELLED' when procedure = 'confirm' then 'COMPLETED' else (['PENDING', 'CONFIRMED', 'PREPARING', 'SHIPPED', 'DELIVERED', 'COMPLETED', 'CANCELLED', 'RETURNED'])[(key % 8 + 1)::int] end as target,
    cast(case procedure when 'force' then 1 when 'update' then vendor_id + 1000000 + (key % 6 = 0)::int else customer_id + (key % 6 = 0)::int end as bigint) as "by", case when key % 8 <> 0 then concat('note ', key) end as note
  from (select checkout_id, vendor_id, customer_id, status, checkout_id + vendor_id as key, (['cancel', 'confirm', 'update', 'force'])[(checkout_id % 4 + 1)::int] as procedure from vendor_order) o) c""",
    "lifecycle_change": """
select l_orderkey as order_id, target, actor, row_number() over (partition by l_orderkey order by l_shipdate, target, actor) as k from (
  select *, ['CONFIRMED', 'PREPARING', 'SHIPPED', 'DELIVERED', 'COMPLETED', 'CANCELLED'][l_linenumber % 6 + 1] as target, case when l_linenumber % 6 = 4 then 'CUSTOMER' else 'VENDOR' end as actor from lineitem)""",
    "lifecycle_state": """
select o_orderkey as order_id, cast(0 as bigint) as k, 'PENDING' as status, 0 as applied, 0 as refused from orders
union all
select s.order_id, c.k, case when e.old is null then s.status else c.target end, s.applied + cast(e.old is not null as int), s.refused + cast(e.old is null as int)
from lifecycle_state s join lifecycle_change c on c.order_id = s.order_id and c.k = s.k + 1 left join edge e on e.old = s.status and e.new = c.target and e.actor = c.actor""",
    "try": """
select *, sent_at + to_seconds(seq * (code_id % 9 * 10 + 5)) >= sent_at + interval 300 seconds as late, seq = code_id % 7 + 1 as matches from (
  select id as code_id, created_at as sent_at, unnest(range(1, id % 8 + 2)) as seq from otp_code)""",
    "counted_try": """
select *, count(*) filter (where not late and not matches) over (partition by code_id order by seq rows between unbounded preceding and 1 preceding) as wrong from try""",
    "setting_change": """
select event_id as id, ts, case when event_id % 4 = 3 then concat('banner_', event_id % 50) else ['commission_rate', 'delivery_fee', 'support_phone'][event_id % 3 + 1] end as key,
  [n, concat(n, 'e-2'), concat('"', n, '"'), props, 'null', concat('{', n), concat('-', n, '.50')][event_id % 7 + 1] as value from (select *, regexp_extract(props, '([0-9]+)', 1) as n from events where event_type = 'error')""",
    "typed_change": """
select *, case when event_type = 'number' then cast(value as double) end as number, event_type as type from (
  select *, case when not json_valid(value) then null when json_type(value) in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'number' when json_type(value) = 'VARCHAR' then 'string' else lower(json_type(value)) end as event_type from setting_change)""",
    "setting_kept": """
select key, arg_max(value, (ts, id)) as value, arg_max(id, (ts, id)) as id from setting_change where id % 2 = 0 group by 1""",
    "setting_now": """
select coalesce(max(number) filter (where t.key = 'commission_rate'), 0.1::double) as commission_rate, coalesce(max(number) filter (where t.key = 'delivery_fee'), 5000::double) as delivery_fee from typed_change t where id in (select id from setting_kept)""",
    "session_log": """
select event_id as id, user_id, ts, event_type, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id) as chain from events where event_type in ('click', 'error', 'signup')""",
    "made_log": """
select id, chain, greatest(0, row_number() over (partition by chain, user_id order by ts, id) - 1 - case when id % 3 = 0 then 1 else 0 end) as number, ts as moment, case when event_type = 'error' and id % 5 = 0 then 'logout' else 'refresh' end as kind
from session_log where event_type <> 'signup'""",
    "session_step": """
select l.*, row_number() over (partition by l.chain order by l.moment, l.id) as k, coalesce(u.is_blocked, true) as blocked from made_log l join otp_code o on o.id = l.chain left join app_user u on u.id = o.phone_key""",
    "token_state": """
select id as chain, cast(null as bigint) as id, cast(0 as bigint) as k, cast(0 as bigint) as after, created_at as issued_at, true as is_open, cast(null as varchar) as verdict from otp_code
union all
select chain, id, k, case when kind = 'refresh' and verdict in ('ok', 'blocked') then after + 1 else after end, case when kind = 'refresh' and verdict in ('ok', 'blocked') then moment else issued_at end,
  is_open and not (kind = 'logout' and number = after), verdict
from (select x.*, t.after, t.issued_at, t.is_open, case when kind = 'logout' then 'ok' when number > t.after then 'unknown' when number < t.after or not t.is_open then 'revoked'
    when moment >= t.issued_at + interval 5 days then 'expired' when blocked then 'blocked' else 'ok' end as verdict from token_state t join session_step x on x.chain = t.chain and x.k = t.k + 1)""",
    "swept_order": """
select * replace (case when status = 'PENDING' and placed_at + interval 30 minutes <= timestamp '1998-01-01' then 'CANCELLED' else status end as status) from vendor_order""",
    "my_order": """
select *, max(place) over (partition by customer_id) as most from (
  select o.customer_id, cast(row_number() over (partition by o.customer_id order by o.placed_at desc, o.checkout_id, o.vendor_id) as int) as place, o.checkout_id, o.vendor_id, v.store_name, o.status, o.item_count,
    (select arg_min(p.title, i.product_id) from order_item i join product p on p.id = i.product_id where i.checkout_id = o.checkout_id and i.vendor_id = o.vendor_id) as first_item,
    strftime(o.placed_at, '%Y-%m-%d %H:%M:%S') as placed_at, cast(o.subtotal + 5000 as double) as total from swept_order o left join vendor v on v.id = o.vendor_id)""",
    "input_rule": _input_rules(),
    "broken_rule": "select kind, id, r, rule, n from input_rule where not ok",
    "norm": r"""
select doc_id, lower(trim(regexp_replace(translate(regexp_replace(nfkc, '[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]', '', 'g'), 'آأإٱىةؤئ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'ااااي' || 'هوي' || '01234567890123456789'), '\s+', ' ', 'g'))) as t
from (select doc_id, coalesce(text, '') as nfkc from documents)""",
}

PLACED = "strftime(placed_at, '%Y-%m-%d %H:%M:%S') as placed_at"
BUYER = "coalesce(u.name, u.phone) as buyer, cast(o.subtotal + o.delivery_fee as double) as total"


def _newest(by: str, limit: int) -> str:
    return f"""
select o.customer_id, o.vendor_id, o.checkout_id, o.place, o.status, o.item_count, {PLACED}, {BUYER}
from (select *, cast(row_number() over (partition by {by} order by placed_at desc, checkout_id, vendor_id) as int) as place from vendor_order) o join app_user u on u.id = o.customer_id where place <= {limit}"""


def _rule(name: str, rows: str, holds: str) -> str:
    return f"select '{name}' as rule_id, count(*) filter (where not coalesce({holds}, false)) as broken, count(*) as total from {rows}"


QUERIES = {
    "order_place_verdicts": "select checkout_id, verdict, lines from verdict",
    "order_place_orders": """
select checkout_id, vendor_id, customer_id, cast(row_number() over (partition by checkout_id order by first_line, vendor_id) as int) as place, 'PENDING' as status, items, cast(subtotal as double) as subtotal, cast(5000 as double) as delivery_fee,
  cast(subtotal + 5000 as double) as total, cast(rate as double) as rate, cast(floor(subtotal * rate + cast(0.5 as decimal(2,1))) as double) as commission from placed_order""",
    "order_place_items": """
select checkout_id, vendor_id, line, product_id, variant_id, title, quantity, cast(unit_price as double) as unit_price, cast(unit_price * quantity as double) as line_total, 'ACTIVE' as reservation,
  strftime(placed_at + interval 30 minutes, '%Y-%m-%d %H:%M:%S') as expires_at from accepted""",
    "order_place_notices": """
select checkout_id, vendor_id, unnest(['history', 'order.placed', 'order.new']) as kind, unnest([customer_id, customer_id, vendor_user_id]) as user_id,
  unnest(['PENDING', concat('طلبك رقم ', number, ' بانتظار تأكيد البائع.'), concat('لديك طلب جديد رقم ', number, '.')]) as body
from (select *, concat('SQ-', strftime(placed_at, '%y%m'), '-', case when length(serial::varchar) >= 4 then serial::varchar else lpad(serial::varchar, 4, '0') end) as number from numbered_order)""",
    "order_place_numbers": """
select checkout_id, vendor_id, place, serial, concat('SQ-', strftime(placed_at, '%y%m'), '-', case when length(serial::varchar) >= 4 then serial::varchar else lpad(serial::varchar, 4, '0') end) as number from numbered_order""",
    "order_serials": """
select checkout_id, vendor_id, serial, concat('SQ-', strftime(placed_at, '%y%m'), '-', case when length(serial::varchar) >= 4 then serial::varchar else lpad(serial::varchar, 4, '0') end) as number from (
  select *, row_number() over (order by placed_at, checkout_id, first_line, vendor_id) as serial from (
    select l_orderkey as checkout_id, l_partkey % (select count(*) from supplier) as vendor_id, min(l_linenumber) as first_line, any_value(o_orderdate) as placed_at from lineitem join orders on o_orderkey = l_orderkey group by 1, 2))""",
    "product_cards": """
select l.id, l.title, l.store_name, cast(l.base_price as double) as base_price, arg_min(i.url, i.sort_order) as image, count(i.id) as images from listed l left join product_image i on i.product_id = l.id group by 1, 2, 3, 4""",
    "product_images_create": """
select a.product_id, a.verdict, cast(coalesce(len(a.images), 0) as int) as asked, n.sort_order, n.url from asked_list a left join new_image n on n.product_id = a.product_id""",
    "product_images_replace": """
select coalesce(i.product_id, n.product_id) as product_id, coalesce(i.sort_order, n.sort_order) as sort_order, coalesce(n.url, i.url) as url,
  case when a.product_id is null or i.url is not distinct from n.url then 'keep' when n.url is null then 'remove' when i.url is null then 'add' else 'change' end as action
from product_image i full join new_image n on n.product_id = i.product_id and n.sort_order = i.sort_order
left join (select product_id from asked_list where verdict = 'ok' and images is not null) a on a.product_id = coalesce(i.product_id, n.product_id)""",
    "order_change_orders": """
select checkout_id, vendor_id, status, target, actor, verdict, case when verdict = 'ok' then target else status end as after, case when verdict = 'ok' and target = 'CANCELLED' then note end as cancel_reason from judged_request""",
    "order_change_history": """
select checkout_id, vendor_id, status as from_status, target as to_status, actor_id as changed_by, note, customer_id as notified,
  concat('طلبك SQ-', strftime(placed_at, '%y%m'), '-', case when length(checkout_id::varchar) >= 4 then checkout_id::varchar else lpad(checkout_id::varchar, 4, '0') end, ': ', case target when 'CONFIRMED' then 'تم التأكيد' when 'PREPARING' then 'قيد التحضير'
    when 'SHIPPED' then 'تم الشحن' when 'DELIVERED' then 'تم التوصيل' when 'COMPLETED' then 'مكتمل' when 'CANCELLED' then 'ملغى' when 'RETURNED' then 'مُرتجع' else 'بانتظار التأكيد' end, '.') as body,
  case when target = 'DELIVERED' then 'CONSUMED' when target in ('CANCELLED', 'RETURNED') then 'RELEASED' else 'ACTIVE' end as reservations from judged_request where verdict = 'ok'""",
    "order_change_stock": """
select i.product_id, i.variant_id, cast(sum(i.quantity * case when target = 'DELIVERED' then -1 when target = 'RETURNED' and status = 'DELIVERED' then 1 else 0 end) as bigint) as stock,
  cast(sum(i.quantity * case when target = 'RETURNED' and status = 'DELIVERED' then 0 else -1 end) as bigint) as reserved, cast(sum(i.quantity * case when target = 'DELIVERED' then 1 when target = 'RETURNED' and status = 'DELIVERED' then -1 else 0 end) as bigint) as sold
from order_item i join judged_request r on r.checkout_id = i.checkout_id and r.vendor_id = i.vendor_id where verdict = 'ok' and target in ('DELIVERED', 'CANCELLED', 'RETURNED') group by 1, 2""",
    "settle_stamps": f"select checkout_id, vendor_id, concat('P', vendor_id) as payout_id, cast(amount as double) as amount from full_commission where payout_id is null and status in {DONE}",
    "settle_audit": f"""
select concat('P', c.vendor_id) as entity_id, 'Payout' as entity_type, 'payout.create' as action, concat('{{"vendorId":', c.vendor_id, ',"amount":', cast(sum(subtotal - amount) as decimal(18,2)), ',"commissions":', count(*), '}}') as after,
  c.vendor_id + 1000000 as notified, 'payout.paid' as notice from full_commission c join vendor v on v.id = c.vendor_id where payout_id is null and c.status in {DONE} group by c.vendor_id""",
    "vendor_decisions": """
select id, 1 as actor_id, 'VendorProfile' as entity_type, concat('vendor.', lower(decision)) as action, concat('{"status":"', status, '"}') as before, concat('{"status":"', decision, '"}') as after, decision as status,
  case when decision = 'REJECTED' then note end as rejection_note, user_id as notified, case decision when 'APPROVED' then 'تم اعتماد متجرك' when 'REJECTED' then 'تم رفض طلب المتجر' else 'تم تعليق متجرك' end as title, note as body
from (select *, ['APPROVED', 'REJECTED', 'SUSPENDED'][id % 3 + 1] as decision, case when id % 4 <> 1 then concat('note ', id) end as note from vendor where status = 'PENDING' or id % 6 = 2)""",
    "product_decisions": """
select p.id, 1 as actor_id, 'Product' as entity_type, case when p.id % 3 = 0 then 'product.reject' else 'product.approve' end as action, '{"status":"PENDING_REVIEW"}' as before,
  case when p.id % 3 = 0 then '{"status":"REJECTED"}' else '{"status":"ACTIVE"}' end as after, case when p.id % 3 = 0 then 'REJECTED' else 'ACTIVE' end as status, v.user_id as notified,
  case when p.id % 3 = 0 then 'تم رفض منتجك' else 'تم نشر منتجك' end as title, case when p.id % 3 = 0 then concat('note ', p.id) else concat('«', p.title, '» أصبح منشوراً.') end as body
from product p join vendor v on v.id = p.vendor_id where p.status = 'PENDING_REVIEW'""",
    "product_create": r"""
select p.id as key, p.vendor_id, p.category_id, concat('New ', p.title) as title, lower(concat('New ', p.title)) as title_norm,
  concat(regexp_replace(regexp_replace(lower(concat('New ', p.title)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), '-', lpad(lower(to_base(p.id, 36)), 5, '0')) as slug, cast(p.base_price as double) as base_price, 'DRAFT' as status
from product p join vendor v on v.id = p.vendor_id where p.id % 9 = 4 and v.status = 'APPROVED'""",
    "product_update": """
select id, vendor_id, category_id, case when hit and id % 2 = 1 then concat('Edited ', title) else title end as title, case when hit and id % 2 = 1 then lower(concat('Edited ', title)) else title_norm end as title_norm,
  cast(case when hit and id % 5 = 0 then 999 else base_price end as double) as base_price, case when hit and status = 'ACTIVE' then 'PENDING_REVIEW' else status end as status
from (select *, id % 8 = 5 and id % 3 <> 0 and vendor_id in (select id from vendor) as hit from product)""",
    "cart_totals": """
select cart_id, cast(sum(quantity) as bigint) as units, cast(sum(price * quantity) as double) as subtotal, cast(count(distinct vendor_id) * 5000 as double) as delivery, cast(sum(price * quantity) + count(distinct vendor_id) * 5000 as double) as total
from (select i.checkout_id as cart_id, i.variant_id, p.vendor_id, x.price, least(sum(i.quantity), greatest(0, any_value(x.stock) - any_value(x.reserved_stock))) as quantity
  from order_item i join product_variant x on x.id = i.variant_id join product p on p.id = i.product_id group by 1, 2, 3, 4) group by 1""",
    "review_mine": "select user_id, product_id, id, rating, status from (select *, row_number() over (partition by user_id, product_id order by created_at desc, id desc) as k from review) where k = 1",
    "auth_me": "select id, phone, name, role from app_user where not is_blocked",
    "vendor_product_detail": """
select p.id, p.vendor_id, p.title, p.category_id, cast(p.base_price as double) as base_price, p.status,
  coalesce((select string_agg(concat(x.id, ':', cast(x.price as decimal(13,2)), ':', x.stock, ':', x.is_active), ',' order by x.id) from product_variant x where x.product_id = p.id), '') as variants from product p""",
    "order_calls": "select checkout_id, vendor_id, procedure, \"by\", target, verdict, case when verdict = 'ok' then target else status end as after from judged_call",
    "order_force_audit": """
select "by" as actor_id, 'order.force_status' as action, 'Order' as entity_type, concat(checkout_id, '/', vendor_id) as entity_id,
  case when note is null then concat('{"status":"', target, '"}') else concat('{"status":"', target, '","note":"', note, '"}') end as after from judged_call where verdict = 'ok' and procedure = 'force'""",
    "cart_changes": """
select * from (with recursive made as (select *, row_number() over (partition by cart_id, variant_id order by event_id) as k from (
    select user_id as cart_id, (event_id % 7 + 1) * 10 as variant_id, event_id, op, case op when 'set' then event_id % 6 - 1 else event_id % 4 + 1 end as quantity
    from (select *, case when event_id % 11 = 3 then 'remove' when event_id % 3 = 1 then 'set' else 'add' end as op from events))),
  known as (select m.*, x.price, greatest(0, x.stock - x.reserved_stock) as most from made m join product_variant x on x.id = m.variant_id),
  folded as (
    select cart_id, variant_id, price, most, cast(0 as bigint) as k, cast(0 as bigint) as quantity from known where k = 1
    union all select f.cart_id, f.variant_id, f.price, f.most, r.k, cast(case when r.op = 'remove' then 0 when r.op = 'add' then least(f.quantity + r.quantity, f.most) when f.quantity > 0 then greatest(0, least(r.quantity, f.most)) else 0 end as bigint)
    from folded f join known r on r.cart_id = f.cart_id and r.variant_id = f.variant_id and r.k = f.k + 1)
  select cart_id, variant_id, cast(arg_max(quantity, k) as int) as quantity, cast(any_value(price) as double) as price from folded group by 1, 2 having arg_max(quantity, k) > 0)""",
    "local_stores": """
select * from (with rated as (select v.id, v.governorate_id, coalesce(r.hundredths, 0) / 100.0::double as rating_avg from vendor v left join vendor_rating r on r.vendor_id = v.id where v.status = 'APPROVED'),
  best as (select *, cast(row_number() over (partition by governorate_id order by rating_avg desc, id) as int) as place from rated where governorate_id is not null)
  select governorate_id, id, place, rating_avg, true as is_local from best where place <= 60
  union all select g.id, e.id, e.place, e.rating_avg, false from governorate g, (select *, cast(row_number() over (order by rating_avg desc, id) as int) as place from rated) e where e.place <= 60 and g.id not in (select governorate_id from best))""",
    "local_products": """
select governorate_id, id, place, true as is_local from local_listed where place <= 10
union all select g.id, e.id, e.place, false from governorate g, (select id, cast(row_number() over (order by id desc) as int) as place from listed) e where e.place <= 10 and g.id not in (select governorate_id from local_listed)""",
    "variant_labels": "select x.id, case when x.id % 10 = 0 then 'افتراضي' else concat('size: ', p_size, '، brand: ', p_brand) end as label from product_variant x join part on p_partkey = x.product_id",
    "rate_percent": "select id, cast(floor(commission_rate * 100 + 0.5) as bigint) as shown, cast(commission_rate * 100 as double) as percent from vendor where commission_rate is not null",
    "slug_round_trip": r"""
select id, url_encode(slug) as encoded, slug, 'a+b%zz' as broken from (select id, substr(regexp_replace(regexp_replace(lower(concat('متجر + ', title)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) as slug from product)""",
    "session_tokens": "select id, sha256(concat('token-', id)) as token_hash from otp_code",
    "ship_to": """select c_custkey as id, concat('{"fullName":"', c_name, '","governorate":"', g.name_ar, '","area":"', a.name_ar, '"}') as ship_to from customer join area a on a.id = c_nationkey join governorate g on g.id = a.governorate_id""",
    "next_statuses": """
select o.status, e.actor, string_agg(distinct e.new, ',' order by e.new) as targets, any_value(o.n) as checkouts
from (select status, count(*) as n from (
  select case o_orderstatus when 'O' then case o_orderkey % 4 when 0 then 'PENDING' when 1 then 'CONFIRMED' when 2 then 'PREPARING' else 'SHIPPED' end
    when 'F' then case o_orderkey % 2 when 0 then 'DELIVERED' else 'COMPLETED' end else case o_orderkey % 3 when 0 then 'CANCELLED' when 1 then 'RETURNED' else 'COMPLETED' end end as status from orders) group by 1) o join (select old, new, actor from edge union all select distinct old, new, 'ADMIN' from edge) e on e.old = o.status group by 1, 2""",
    "role_guard": """
select wanted, count(*) filter (where role = 'ADMIN' or role = wanted) as allowed, count(*) as users from (select case when id % 97 = 5 then 'ADMIN' else role end as role, unnest(['CUSTOMER', 'VENDOR', 'ADMIN']) as wanted from app_user) group by 1""",
    "otp_verify": """
select code_id, cast(seq as int) as seq, matches, case when coalesce(bool_or(not late and ((matches and wrong < 5) or wrong >= 5)) over (partition by code_id order by seq rows between unbounded preceding and 1 preceding), false) then 'none'
  when late then 'expired' when wrong >= 5 then 'too_many' when matches then 'ok' else 'wrong' end as verdict from counted_try""",
    "category_changes": """
select id, case name_ar when 'Brand#11' then 'Brand#11 new' else name_ar end as name_ar, parent_id, case when name_ar = 'Brand#12' and parent_id is not null then false else is_active end as is_active,
  case when parent_id is null then 'kept' when name_ar in ('Brand#11', 'Brand#12') then 'category.update' when name_ar = 'Brand#14' then 'refused' else 'kept' end as action from category
union all select concat(id, '/empty'), 'Empty', id, true, 'category.delete' from category where parent_id is null
union all select concat(id, '/new'), 'New', id, true, 'category.create' from category where parent_id is null""",
    "lifecycle_fold": "select order_id, arg_max(status, k) as status, arg_max(applied, k) as applied, arg_max(refused, k) as refused from lifecycle_state group by 1",
    "vendor_status_map": """
select v.id, coalesce((select string_agg(concat(status, ':', n), ',' order by status) from (select status, count(*) as n from vendor_order where vendor_id = v.id group by 1)), '') as orders,
  coalesce((select string_agg(concat(status, ':', n), ',' order by status) from (select status, count(*) as n from product where vendor_id = v.id group by 1)), '') as products from vendor v""",
    "product_search_rating": """
select id, title, vendor_id, store_name, category_id, base_price, rating_avg, rating_count, cast(place as int) as place, total > 50 as has_next from (
  select l.id, title, vendor_id, store_name, category_id, cast(base_price as double) as base_price, coalesce(hundredths, 0) / 100.0::double as rating_avg, coalesce(rating_count, 0) as rating_count,
    row_number() over (order by coalesce(hundredths, 0) desc, l.id) as place, count(*) over () as total from listed l left join product_rating r on r.product_id = l.id)
where place <= 50""",
    "otp_limits": """
select *, short >= 3 or long >= 8 as refused from (
  select id, phone_key, count(*) over (w range between interval 10 minutes preceding and current row) - 1 as short, count(*) over (w range between interval 60 minutes preceding and current row) - 1 as long from (
    select id, phone_key % 4 as phone_key, timestamp '2024-01-01' + to_microseconds(cast((epoch_us(date_trunc('second', created_at)) - epoch_us(timestamp '2024-01-01')) / 100 as bigint)) as created_at from otp_code)
  window w as (partition by phone_key order by created_at))""",
    "settlement_balances": f"""
select c.vendor_id, v.store_name, cast(sum(subtotal - amount) as double) as balance, count(*) as orders from full_commission c join vendor v on v.id = c.vendor_id
where payout_id is null and c.status in {DONE} group by 1, 2""",
    "status_counts": """
select 'vendor' as entity, status, count(*) as n from vendor group by 2 union all select 'product', status, count(*) from product group by 2 union all select 'order', status, count(*) from vendor_order group by 2""",
    "gmv_summary": f"select cast(coalesce(sum(subtotal + delivery_fee), 0) as double) as gmv, cast(coalesce(sum(amount), 0) as double) as commission_revenue, count(*) as realized_orders from full_commission where status in {DONE}",
    "vendor_analytics": f"""
select vendor_id, cast(coalesce(sum(subtotal) filter (where status in {DONE}), 0) as double) as gross, cast(coalesce(sum(amount) filter (where status in {DONE}), 0) as double) as commission,
  cast(coalesce(sum(subtotal) filter (where status in {DONE}), 0) as double) - cast(coalesce(sum(amount) filter (where status in {DONE}), 0) as double) as net,
  count(*) filter (where status in {DONE}) as completed_orders, count(*) filter (where status = 'PENDING') as pending_orders from full_commission group by 1""",
    "vendor_top_products": """
select vendor_id, place, product_id, title, sold_count from (
  select p.vendor_id, s.product_id, p.title, s.sold_count, cast(row_number() over (partition by p.vendor_id order by s.sold_count desc, s.product_id) as int) as place from sold s join product p on p.id = s.product_id where s.sold_count > 0)
where place <= 5""",
    "store_directory": """
select v.id, v.store_name, g.name_ar as governorate, coalesce(r.hundredths, 0) / 100.0::double as rating_avg, coalesce(r.rating_count, 0) as rating_count,
  (select count(*) from product p where p.vendor_id = v.id and p.status = 'ACTIVE') as product_count
from vendor v left join governorate g on g.id = v.governorate_id left join vendor_rating r on r.vendor_id = v.id where v.status = 'APPROVED' order by rating_avg desc, v.id limit 60""",
    "category_tree": """
select r.id, r.name_ar, coalesce(string_agg(c.id, ',' order by c.id), '') as children, count(c.id) as n_children
from category r left join category c on c.parent_id = r.id and c.is_active where r.parent_id is null and r.is_active group by 1, 2""",
    "product_search": """
select id, title, vendor_id, store_name, category_id, cast(base_price as double) as base_price from listed where contains(title_norm, 'a') and contains(title_norm, 'e') and base_price between 950 and 1400""",
    "product_search_category": """
select id, title, vendor_id, store_name, category_id, cast(base_price as double) as base_price from listed
where governorate_id = 1 and category_id in (select min(p_type) from part union all select id from category where parent_id = (select min(p_type) from part))""",
    "product_search_page": """
select id, title, vendor_id, store_name, category_id, cast(base_price as double) as base_price from listed where base_price > 950 or (base_price = 950 and id > 10) order by base_price, id limit 20""",
    "suggest_products": "select l.id, l.title, coalesce(s.sold_count, 0) as sold_count from listed l left join sold s on s.product_id = l.id where contains(title_norm, 'al') order by sold_count desc, l.id limit 6",
    "suggest_categories": "select id, name_ar from (select * from category where is_active order by id limit 20) where contains(lower(name_ar), 'brand#1') order by id limit 4",
    "product_detail": """
select p.id, p.title, v.store_name, c.name_ar as category_name, cast(p.base_price as double) as base_price,
  coalesce((select string_agg(concat(x.id, ':', greatest(0, x.stock - x.reserved_stock)), ',' order by x.id) from product_variant x where x.product_id = p.id and x.is_active), '') as variants
from product p join vendor v on v.id = p.vendor_id join category c on c.id = p.category_id where p.status = 'ACTIVE'""",
    "store_page": "select vendor_id, store_name, place, id, title from (select *, cast(row_number() over (partition by vendor_id order by id desc) as int) as place from listed) where place <= 24",
    "governorate_areas": "select g.id, g.name_ar, g.code, coalesce(string_agg(a.name_ar, ',' order by a.name_ar), '') as areas from governorate g left join area a on a.governorate_id = g.id group by 1, 2, 3",
    "customer_orders": _newest("customer_id", 10),
    "vendor_orders": _newest("vendor_id", 30),
    "admin_orders": f"""
select o.checkout_id, o.vendor_id, v.store_name, o.status, {PLACED}, {BUYER} from (select * from vendor_order order by placed_at desc, checkout_id, vendor_id limit 50) o
join app_user u on u.id = o.customer_id join vendor v on v.id = o.vendor_id""",
    "order_detail": """
select o.checkout_id, o.vendor_id, o.customer_id, o.status, cast(sum(i.quantity) as bigint) as units, string_agg(concat(i.product_id, ':', i.quantity), ',' order by i.product_id, i.quantity, i.line_total) as items, cast(o.subtotal as double) as subtotal
from vendor_order o join order_item i on i.checkout_id = o.checkout_id and i.vendor_id = o.vendor_id group by 1, 2, 3, 4, o.subtotal""",
    "order_page": """
select o.checkout_id, o.vendor_id, o.customer_id, v.store_name, o.status, i.items, h.history, cast(o.subtotal as double) as subtotal, cast(o.delivery_fee as double) as delivery_fee,
  cast(v.rate as double) as rate, cast(floor(o.subtotal * v.rate + 0.5) as double) as commission, cast(o.subtotal - floor(o.subtotal * v.rate + 0.5) as double) as net
from vendor_order o
join (select checkout_id, vendor_id, string_agg(concat(product_id, ':', quantity), ',' order by product_id, quantity, line_total) as items from order_item group by 1, 2) i on i.checkout_id = o.checkout_id and i.vendor_id = o.vendor_id
join (select c.checkout_id, string_agg(concat(p.state, '@', strftime(c.placed_at + to_days(p.k), '%Y-%m-%d')), ',' order by p.k) as history
  from (select distinct checkout_id, placed_at, status from vendor_order) c
  join (select status, unnest(states) as state, cast(generate_subscripts(states, 1) as int) - 1 as k from (values
    ('PENDING', ['PENDING']), ('CONFIRMED', ['PENDING', 'CONFIRMED']), ('PREPARING', ['PENDING', 'CONFIRMED', 'PREPARING']), ('SHIPPED', ['PENDING', 'CONFIRMED', 'PREPARING', 'SHIPPED']),
    ('DELIVERED', ['PENDING', 'CONFIRMED', 'PREPARING', 'SHIPPED', 'DELIVERED']), ('COMPLETED', ['PENDING', 'CONFIRMED', 'PREPARING', 'SHIPPED', 'DELIVERED', 'COMPLETED']),
    ('RETURNED', ['PENDING', 'CONFIRMED', 'PREPARING', 'SHIPPED', 'DELIVERED', 'RETURNED']), ('CANCELLED', ['PENDING', 'CANCELLED'])) as s(status, states)) p on p.status = c.status group by 1) h on h.checkout_id = o.checkout_id
left join (select id, store_name, coalesce(commission_rate, 0.1000) as rate from vendor) v on v.id = o.vendor_id""",
    "admin_vendors": """
select v.id, v.store_name, v.status, u.phone, g.name_ar as governorate, (select count(*) from product p where p.vendor_id = v.id) as products, (select count(*) from vendor_order o where o.vendor_id = v.id) as orders
from vendor v join app_user u on u.id = v.user_id left join governorate g on g.id = v.governorate_id""",
    "admin_categories": """
select *, products = 0 and children = 0 as removable from (
  select id, name_ar, parent_id, is_active, (select count(*) from product p where p.category_id = c.id) as products, (select count(*) from category k where k.parent_id = c.id) as children from category c)""",
    "pending_products": "select p.id, p.title, v.store_name, c.name_ar as category_name from product p join vendor v on v.id = p.vendor_id join category c on c.id = p.category_id where p.status = 'PENDING_REVIEW'",
    "payout_history": """
select payout_id, vendor_id, cast(amount as double) as amount, strftime(period_end, '%Y-%m-%d %H:%M:%S') as period_end, orders from (
  select payout_id, vendor_id, sum(subtotal - amount) as amount, max(placed_at) as period_end, count(*) as orders from full_commission where payout_id is not null group by 1, 2 order by 4 desc, 1 limit 50)""",
    "user_search": "select id, phone, name, role from app_user where (contains(phone, '00012') or contains(name, '00012')) and role = 'CUSTOMER' order by id desc limit 100",
    "audit_feed": """
select a.id, a.action, strftime(a.created_at, '%Y-%m-%d %H:%M:%S') as created_at, coalesce(u.name, u.phone, 'النظام') as actor
from (select * from audit_log order by created_at desc, id desc limit 50) a left join app_user u on u.id = a.actor_id""",
    "settings": "select * from setting_now",
    "my_orders_swept": "select customer_id, place, checkout_id, vendor_id, store_name, status, item_count, first_item, placed_at, total, most > 5 as has_next from my_order where place <= 5",
    "my_orders_next": "select customer_id, cast(place - 5 as int) as place, checkout_id, vendor_id, store_name, status, item_count, first_item, placed_at, total, most > 10 as has_next from my_order where place between 6 and 10",
    "dashboard": f"""
select (select count(*) from app_user) as users, (select string_agg(concat(status, ':', n), ',' order by status) from (select status, count(*) as n from vendor group by 1)) as vendors,
  (select string_agg(concat(status, ':', n), ',' order by status) from (select status, count(*) as n from product group by 1)) as products, (select string_agg(concat(status, ':', n), ',' order by status) from (select status, count(*) as n from swept_order group by 1)) as orders,
  cast(coalesce(sum(o.subtotal + o.delivery_fee), 0) as double) as gmv, cast(coalesce(sum(c.amount), 0) as double) as commission_revenue, count(*) as realized_orders,
  (select count(*) from vendor where status = 'PENDING') as pending_vendors, (select count(*) from product where status = 'PENDING_REVIEW') as pending_products
from swept_order o join commission c on c.checkout_id = o.checkout_id and c.vendor_id = o.vendor_id where o.status in {DONE}""",
    "validation_rejects": "select kind, id, string_agg(rule, ',' order by n) as broken from broken_rule group by kind, id, r",
    "validation_report": """
select rule as rule_id, count(*) filter (where not ok) as broken, count(*) as total from input_rule group by 1""",
    "setting_types": """
select id, key, type, number, coalesce(number, case key when 'commission_rate' then 0.1 when 'delivery_fee' then 5000 end::double) as read_as from typed_change""",
    "settings_in_force": """
select v.id, cast(rate as double) as rate, cast(floor(100000 * rate + 0.5) as double) as on_100000, delivery_fee
from (select id, coalesce(commission_rate, cast(least(greatest((select commission_rate from setting_now), 0), 1) as decimal(5,4))) as rate from vendor) v, setting_now""",
    "product_search_indexed": "select id, title, vendor_id, store_name, category_id, cast(base_price as double) as base_price from listed where contains(title_norm, 'ing') and contains(title_norm, 're')",
    "suggest_indexed": "select l.id, l.title, coalesce(s.sold_count, 0) as sold_count from listed l left join sold s on s.product_id = l.id where contains(title_norm, 'ring') order by sold_count desc, l.id limit 6",
    "document_phrases": "select doc_id from documents where contains(lower(text), 'ation') and contains(lower(text), 'ment')",
    "session_rotation": """
select id, case when kind = 'logout' then 'ok' when made_log.chain is null then 'unknown' else verdict end as verdict, case when kind = 'refresh' and verdict = 'ok' then after end as issued from made_log left join token_state using (id)""",
    "vendor_inventory": """
select p.id, p.vendor_id, p.status, coalesce(cast(sum(x.stock) as bigint), 0) as stock, coalesce(cast(sum(x.reserved_stock) as bigint), 0) as reserved, count(x.id) as variants
from product p left join product_variant x on x.product_id = p.id group by 1, 2, 3""",
    "favorite_toggle": "select user_id, product_id from favorite_toggle group by 1, 2 having count(*) % 2 = 1",
    "favorites_list": """
select f.user_id, f.product_id, p.title, cast(p.base_price as double) as base_price from (select user_id, product_id from favorite_toggle group by 1, 2 having count(*) % 2 = 1) f join product p on p.id = f.product_id where p.status = 'ACTIVE'""",
    "product_reviews": """
select r.id, r.product_id, r.rating, coalesce(u.name, 'مستخدم') as reviewer, strftime(r.created_at, '%Y-%m-%d %H:%M:%S') as created_at from review r left join app_user u on u.id = r.user_id where r.status = 'PUBLISHED'""",
    "notif_feed": """
select user_id, place, id, type, read_at is not null as is_read, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at
from (select *, cast(row_number() over (partition by user_id order by created_at desc, id desc) as int) as place from notification) where place <= 30""",
    "notif_unread": "select user_id, count(*) filter (where read_at is null) as unread, count(*) as total from notification group by 1",
    "address_list": """
select a.user_id, cast(row_number() over (partition by a.user_id order by a.is_default desc, a.id desc) as int) as place, a.id, r.name_ar as area, g.name_ar as governorate, a.is_default
from address a join area r on r.id = a.area_id join governorate g on g.id = r.governorate_id""",
    "default_address": "select user_id, arg_max(id, (case when is_default then 1000000000 else 0 end) - id) as address_id from address group by 1",
    "transition_check": """
select o.status, t.target, a.actor, case when o.status = t.target then 'same' when o.status in ('COMPLETED', 'CANCELLED', 'RETURNED') then 'terminal'
  when not exists (select 1 from edge e where e.old = o.status and e.new = t.target) then 'no_edge'
  when a.actor <> 'ADMIN' and not exists (select 1 from edge e where e.old = o.status and e.new = t.target and e.actor = a.actor) then 'role' else 'ok' end as verdict, o.orders
from (select status, count(*) as orders from vendor_order group by 1) o,
  (select unnest(['PENDING', 'CONFIRMED', 'PREPARING', 'SHIPPED', 'DELIVERED', 'COMPLETED', 'CANCELLED', 'RETURNED']) as target) t, (select unnest(['CUSTOMER', 'VENDOR', 'ADMIN', 'SYSTEM']) as actor) a""",
    "stock_effects": """
select i.variant_id, cast(sum(i.quantity * case o.status when 'SHIPPED' then -1 when 'DELIVERED' then 1 else 0 end) as bigint) as stock,
  cast(sum(i.quantity * case o.status when 'SHIPPED' then -1 when 'PENDING' then -1 else 0 end) as bigint) as reserved, cast(sum(i.quantity * case o.status when 'SHIPPED' then 1 when 'DELIVERED' then -1 else 0 end) as bigint) as sold
from order_item i join vendor_order o on o.checkout_id = i.checkout_id and o.vendor_id = i.vendor_id where o.status in ('PENDING', 'SHIPPED', 'DELIVERED') group by 1""",
    "available_stock": "select id, cast(greatest(0, stock - reserved_stock) as int) as available, case when greatest(0, stock - reserved_stock) < 20 then 'insufficient' else 'ok' end as verdict from product_variant",
    "commission_calc": "select checkout_id, vendor_id, cast(rate as double) as rate, cast(amount as double) as amount, cast(subtotal - amount as double) as net from full_commission",
    "order_numbers": "select checkout_id, vendor_id, concat('SQ-', strftime(placed_at, '%y%m'), '-', case when length(checkout_id::varchar) >= 4 then checkout_id::varchar else lpad(checkout_id::varchar, 4, '0') end) as number from vendor_order",
    "reservation_expiry": "select checkout_id, vendor_id, strftime(placed_at + interval 30 minutes, '%Y-%m-%d %H:%M:%S') as expires_at from vendor_order where status = 'PENDING' and placed_at + interval 30 minutes <= timestamp '1998-01-01'",
    "status_labels": """
select status, case status when 'PENDING' then 'بانتظار التأكيد' when 'CONFIRMED' then 'تم التأكيد' when 'PREPARING' then 'قيد التحضير' when 'SHIPPED' then 'تم الشحن' when 'DELIVERED' then 'تم التوصيل'
  when 'COMPLETED' then 'مكتمل' when 'CANCELLED' then 'ملغى' else 'مُرتجع' end as label, count(*) as n from vendor_order group by 1""",
    "checkout_split": """
select checkout_id, count(*) as orders, cast(sum(item_count) as bigint) as items, cast(sum(subtotal) as double) as subtotal, cast(sum(delivery_fee) as double) as delivery, cast(sum(subtotal + delivery_fee) as double) as total from vendor_order group by 1""",
    "resolve_variant": """
select p.id as product_id, case when count(x.id) = 1 then min(x.id)::varchar end as variant_id, count(x.id) as active_variants from product p left join product_variant x on x.product_id = p.id and x.is_active group by 1""",
    "expired_release": """
select i.variant_id, cast(sum(i.quantity) as bigint) as released, count(*) as lines from order_item i join vendor_order o on o.checkout_id = i.checkout_id and o.vendor_id = i.vendor_id
where o.status = 'PENDING' and o.placed_at + interval 30 minutes <= timestamp '1998-01-01' group by 1""",
    "settle_payouts": f"""
select vendor_id, cast(sum(subtotal - amount) as double) as amount, strftime(min(placed_at), '%Y-%m-%d %H:%M:%S') as period_start, strftime(max(placed_at), '%Y-%m-%d %H:%M:%S') as period_end, count(*) as orders, 'PAID' as status
from full_commission where payout_id is null and status in {DONE} group by 1""",
    "rating_recompute_product": "select product_id, hundredths / 100.0::double as rating_avg, rating_count from product_rating",
    "rating_recompute_vendor": "select vendor_id, hundredths / 100.0::double as rating_avg, rating_count from vendor_rating",
    "review_eligibility": f"""
select r.user_id, r.product_id, r.id, r.rating, exists (select 1 from order_item i join vendor_order o on o.checkout_id = i.checkout_id and o.vendor_id = i.vendor_id where o.status in {DONE} and o.customer_id = r.user_id and i.product_id = r.product_id) as eligible
from (select *, row_number() over (partition by user_id, product_id order by created_at desc, id desc) as k from review) r where k = 1""",
    "product_review_flow": """
select p.id, p.status, case when p.status in ('DRAFT', 'REJECTED') then 'PENDING_REVIEW' when p.status = 'ACTIVE' and v.status = 'SUSPENDED' then 'PENDING_REVIEW' else p.status end as after from product p left join vendor v on v.id = p.vendor_id""",
    "block_user": "select u.id, u.phone, count(o.id) as revoked from app_user u left join otp_code o on o.phone_key = u.id where u.is_blocked group by 1, 2",
    "otp_rate_limit": """
select *, recent > 3 as refused from (select id, phone_key, count(*) over (partition by phone_key order by created_at range between interval 24 hours preceding and current row) as recent from otp_code)""",
    "otp_state": """
select phone_key, arg_max(id, (created_at, id)) as id, count(*) as codes, max(created_at) + interval 300 seconds > timestamp '2024-01-15' as valid from otp_code group by 1""",
    "session_state": """
select id, phone_key, rotated_to::varchar as rotated_to, rotated_to is null and created_at + interval 30 days > timestamp '2024-01-15' as open from (select *, lead(id) over (partition by phone_key order by created_at, id) as rotated_to from otp_code)""",
    "quality_report": " union all ".join(
        [
            _rule("user.phone", "app_user", "regexp_full_match(phone, '[+]9647[0-9]{9}')"), _rule("user.name", "app_user", "length(name) between 2 and 60"), _rule("product.title", "product", "length(title) between 3 and 120"),
            _rule("product.price", "product", "base_price >= 250 and base_price <= 100000000 and base_price = floor(base_price)"), _rule("review.rating", "review", "rating between 1 and 5"), _rule("cart.quantity", "order_item", "quantity between 1 and 99"),
            _rule("variant.stock", "product_variant", "stock between 0 and 1000000"), _rule("vendor.store_name", "vendor", "length(store_name) between 2 and 80"), _rule("vendor.commission_rate", "vendor", "coalesce(commission_rate, 0) between 0 and 1"),
            _rule("product.category", "product", "category_id is not null"), _rule("variant.price", "product_variant", "price >= 250 and price <= 100000000 and price = floor(price)"), _rule("vendor.governorate", "vendor", "governorate_id is not null"), _rule("category.name", "category", "length(name_ar) between 2 and 60"),
        ]
    ),
    "text_normalize": "select doc_id, sha256(t) as sha256 from norm",
    "slugify": r"select doc_id, substr(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) as slug from norm",
    "tokenize": "select doc_id, cast(len(list_filter(string_split(t, ' '), lambda x: x <> '')) as int) as tokens from norm",
    "phone_normalize": """
select id, case when substr(phone, 5, 1) = '7' then phone end as phone, concat('0', substr(phone, 5, 3), ' ', substr(phone, 8, 3), ' ', substr(phone, 11, 4)) as local, cast(null as varchar) as short from app_user""",
    "iqd_format": "select id, concat(format('{:,}', cast(floor(base_price + 0.5) as bigint)), ' د.ع') as price from product",
    "iqd_parse": "select id, cast(floor(base_price + 0.5) as bigint) as amount, cast(0 as bigint) as of_title from product",
    "notif_mark_read": """
select id, user_id, strftime(coalesce(case when id % 22 = 0 then timestamp '2024-02-01' end, read_at, case when user_id % 10 = 3 and user_id in (select id from app_user) then timestamp '2024-02-01' end), '%Y-%m-%d %H:%M:%S') as read_at from notification""",
    "push_subscriptions": """
select endpoint, arg_max(user_id, event_id) as user_id from (select *, concat('https://push.example/', user_id % 40) as endpoint from events) e where event_type = 'click' group by endpoint
having not exists (select 1 from events x where x.event_type = 'error' and concat('https://push.example/', x.user_id % 40) = e.endpoint and x.user_id = arg_max(e.user_id, e.event_id) and x.event_id > max(e.event_id))""",
    "vendor_register": r"""
select id as user_id, name as store_name, concat(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), '-', right(id::varchar, 5)) as slug, lower(name) as slug_norm, 'PENDING' as status, 'VENDOR' as role
from app_user where name is not null and id % 7 = 3 and id not in (select user_id from vendor)""",
    "vendor_settings": r"""
select id, case when id % 3 = 0 then concat('متجر ', id) else store_name end as store_name, case when id % 4 = 0 then cast(id % 5 as int) else governorate_id end as governorate_id,
       regexp_replace(regexp_replace(lower(store_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, case when id % 3 = 0 then concat('متجر ', id) else lower(store_name) end as slug_norm from vendor""",
    "variant_update": """
select id, price, stock, is_active, stock < reserved_stock as oversold from (select x.id, reserved_stock, cast(case when hit and x.id % 3 = 0 then 2500 else price end as double) as price, case when hit then cast(x.id % 20 as int) else stock end as stock, is_active and not (hit and x.id % 8 = 0) as is_active
from (select *, id % 6 = 0 and id % 4 = 0 as hit from product_variant) x)""",
    "product_archive": "select id, case when id % 18 = 0 then 'ARCHIVED' else status end as status from product",
    "settings_update": """
select key, value from setting_kept where key not in (select key from setting_change where id % 2 = 1)
union all select key, arg_max(value, (ts, id)) as value from setting_change where id % 2 = 1 group by 1""",
    "complete_profile": """
select id, case when role = 'CUSTOMER' and id % 10 = 0 then concat('User ', id) else name end as name, case when role = 'CUSTOMER' and id % 20 = 10 then concat('u', id, '@example.com') end as email from app_user""",
}


def with_views(query: str) -> str:
    """The query behind the views and steps that it needs, in the order of their definition."""
    import re

    defined = {**VIEWS, **STEPS}
    needed: set[str] = set()

    def need(sql: str) -> None:
        for name in defined:
            if name not in needed and re.search(rf"\b{name}\b", sql) and sql is not defined[name]:
                needed.add(name)
                need(defined[name])

    need(query)
    parts = [f"{name} as ({sql})" for name, sql in defined.items() if name in needed]
    return f"with recursive {', '.join(parts)} {query}" if parts else query


ORACLES = {name: with_views(sql) for name, sql in QUERIES.items()}
